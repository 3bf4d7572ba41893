"""Mixing sources to target weights over a domain - language - source tree.

Budgets go down the tree. A node's children share its budget by weight; a child
that holds less than its share (its documents times ``max_epochs``) is filled,
and what it falls short of goes to its siblings by weight. As a child counts
with all its leaves can give, a shortage is made up for within a subtree first
and reaches an ancestor's siblings only when the whole subtree is exhausted.

A leaf's documents come in epochs, each in an order of its own (a seeded hash).
A leaf takes whole epochs while its budget lasts, and of the next epoch the
longest prefix whose tokens fit.

No task sorts a leaf: tokens are summed per (leaf, hash bucket), the bucket in
which the prefix ends is found from those sums, and just that bucket's rows are
ordered. Budgets go down level by level as window functions over sums per node,
so the tree may have any number of leaves; the driver sees two totals.

Budgets are whole tokens, rounded down per node, so sums fall short by less than
a token per node. A target's weight is a positive whole number, 1 unless given.

Defined cases: a null domain, language or source is a name of its own, the
empty string; documents without tokens are in whole epochs and inside prefixes, and a leaf without
tokens gives nothing; repeated rows and ids count each; rows of one id are taken by
their tokens, then by a hash of all columns (rows equal in all are alike); an empty
table gives an empty table; extra columns are kept, except that "epochs" is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.common import written

#: Leaves of more bytes than this are met by a shuffle.
BROADCAST_BYTES = 16 << 20


def shares(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Budgets of the children of each parent: ``nodes`` (parent columns, name, w, most, total) with "b".

    By what a child can take for its weight, ascending: the first that can take more than its share of what is left,
    and all after it, get their share of that; those before are filled.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("most").cast("double") / F.col("w"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)  # a frame that grows; one that shrinks is summed anew per row
    taken = F.coalesce(F.sum("most").over(before), F.lit(0))
    rest = F.sum("w").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("w").over(before), F.lit(0))
    wide = "decimal(38,0)"  # products of a budget and weights
    placed = nodes.withColumns({"_left": (F.col("total") - taken).cast("long"), "_rest": rest.cast("long")})
    placed = placed.withColumn("_open", F.col("most").cast(wide) * F.col("_rest") > F.col("_left").cast(wide) * F.col("w"))
    first = F.max(F.when(F.col("_open"), F.struct("_rest", "_left"))).over(Window.partitionBy(*parent))
    placed = placed.withColumn("_first", first)
    part = F.expr(f"(CAST(w AS {wide}) * _first._left) div CAST(_first._rest AS {wide})")
    return placed.withColumn("b", F.when(F.col("_open"), part).otherwise(F.col("most"))).drop("_left", "_rest", "_open", "_first")


def budgets(leaves: DataFrame, names: Sequence[str], want: int, weights: Sequence[Mapping[str, int]], max_epochs: int) -> DataFrame:
    """Per leaf (columns ``names`` and t, its tokens): t, and its budget b out of ``want`` tokens."""
    up = None
    for k, name in enumerate(names):
        known = F.create_map(*[F.lit(x) for pair in weights[k].items() for x in pair]) if weights[k] else None
        weight = F.lit(1) if known is None else F.coalesce(F.try_element_at(known, F.col(name)), F.lit(1))
        nodes = leaves.groupBy(*names[: k + 1]).agg((F.sum("t") * max_epochs).alias("most")).withColumn("w", weight.cast("long"))
        nodes = nodes.withColumn("total", F.lit(want).cast("long")) if up is None else nodes.join(up, [*names[:k]])
        up = shares(nodes, names[:k], name).select(*names[: k + 1], F.col("b").alias("total"))
    return leaves.select(*names, "t").join(up.withColumnRenamed("total", "b"), [*names])


def words(text: str) -> Column:
    """Tokens by white space, for corpora without a token count."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def mix(
    docs: DataFrame,
    levels: Sequence[Column],
    tokens: Column,
    weights: Sequence[Mapping[str, int]],
    *,
    id_col: str = "doc_id",
    budget: int | None = None,
    share_of_corpus: float = 1.0,
    max_epochs: int = 4,
    seed: int = 7,
    narrow: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The selected rows of ``docs`` with "epochs" (int): how many times each is taken.

    ``levels``: the tree's levels as columns of docs, top first. ``budget``: tokens in all; if None,
    ``share_of_corpus`` of the tokens there are. ``narrow``: what ``narrowed`` made of docs, to save a scan.
    """
    names = [f"level{k}" for k in range(len(levels))]
    if narrow is None:
        narrow = narrowed(docs, levels, tokens, id_col)
    leaves = written(narrow.groupBy(*names).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")), "leaves")
    everything, n_rows, n_leaves, long = leaves.agg(F.sum("t"), F.sum("n"), F.count(F.lit(1)), F.sum(sum((F.octet_length(n) for n in names), F.lit(0)))).first()
    want = math.floor((everything or 0) * share_of_corpus) if budget is None else budget
    small = n_leaves * 200 + (long or 0) <= broadcast_bytes
    near = lambda leaf_rows: F.broadcast(leaf_rows) if small else leaf_rows.hint("merge")
    full, rest = F.when(F.col("t") > 0, F.expr("b div t")).otherwise(0), F.when(F.col("t") > 0, F.expr("b % t")).otherwise(0)
    plan = written(budgets(leaves, names, want, weights, max_epochs).select(*names, full.cast("long").alias("full"), rest.cast("long").alias("rest")), "plan")

    # about as many buckets as rows in one, whatever the corpus
    digits = max(1, round(math.log(max(2, n_rows or 0), 16) / 2))
    key = lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full"), F.coalesce(c.cast("string"), F.lit(""))))
    hashed = narrow.join(near(plan.where("rest > 0")), names).withColumn("part", F.substring(key(F.col("id")), 1, digits))
    sums = hashed.groupBy(*names, "part", "rest").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*names).orderBy("part"))
    # the first bucket by whose end the rest is used up; all of the leaf if there is none
    cut = (
        sums.withColumn("upto", upto)
        .where("upto > rest")
        .groupBy(*names)
        .agg(F.min(F.struct("part", (F.col("upto") - F.col("t")).alias("before"))).alias("c"))
        .select(*names, F.col("c.part").alias("cut"), "c.before")
    )
    plan = written(plan.where("full > 0 or rest > 0").join(cut, names, "left").select(F.struct(*names, "full", "rest", "cut", "before").alias("_mix")), "cuts")

    own = [c for c in docs.columns if c != "epochs"]
    # ids and levels get names that no column of docs has
    keyed = docs.withColumns({f"_mix_{n}": F.coalesce(x.cast("string"), F.lit("")) for n, x in zip(names, levels, strict=True)})
    joined = keyed.join(near(plan), [F.col(f"_mix_{n}") == F.col(f"_mix.{n}") for n in names])
    joined = joined.withColumn("_mix_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_mix.full"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    joined = joined.withColumn("_mix_part", F.substring("_mix_key", 1, digits))
    extra = F.when(F.col("_mix.rest") == 0, 0).when(F.col("_mix.cut").isNull() | (F.col("_mix_part") < F.col("_mix.cut")), 1).otherwise(0)
    at_cut = (F.col("_mix.rest") > 0) & (F.col("_mix_part") == F.col("_mix.cut"))
    clear = joined.where(~F.coalesce(at_cut, F.lit(False))).withColumn("_mix_extra", extra)
    ordered = Window.partitionBy(*[f"_mix_{n}" for n in names]).orderBy("_mix_key", "_mix_tokens", "_mix_row").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        joined.where(at_cut)
        .withColumns({"_mix_tokens": tokens, "_mix_row": F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c) for c in own])})
        .withColumn("_mix_extra", (F.col("_mix.before") + F.sum("_mix_tokens").over(ordered) <= F.col("_mix.rest")).cast("int"))
        .drop("_mix_tokens", "_mix_row")
    )
    return (
        clear.unionByName(last)
        .withColumn("_mix_times", (F.col("_mix.full") + F.col("_mix_extra")).cast("int"))
        .where("_mix_times > 0")
        .select(*own, F.col("_mix_times").alias("epochs"))
    )


def narrowed(docs: DataFrame, levels: Sequence[Column], tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """level0, level1, ..., id, tokens of each row."""
    return docs.select(
        *[F.coalesce(x.cast("string"), F.lit("")).alias(f"level{k}") for k, x in enumerate(levels)],
        F.col(id_col).alias("id"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"),
    )


# --- the query and its SQL -----------------------------------------------------------------------

#: Which domain a source belongs to, by the number at its end modulo 4; sources without a number are "other".
DOMAINS = ("web", "books", "reference", "forum")
WEIGHTS: tuple[dict[str, int], ...] = (
    {"web": 4, "books": 3, "reference": 2, "forum": 1},
    {"en": 5, "de": 2, "fr": 2, "es": 1},
    {},
)
MAX_EPOCHS = 4
SEED = 7


def domain(source: str = "source") -> Column:
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"([0-9]{1,9})$", 1).try_cast("int")
    return F.when(number.isNull(), "other").otherwise(F.element_at(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS) + 1))


def _case(column: str, weights: Mapping[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _level(name: str, parent: list[str], column: str, weights: Mapping[str, int]) -> str:
    """SQL of one level: each child's budget b from its parent's, by share()."""
    by = ", ".join(parent)
    up = f"SELECT {by}, b FROM {parent_table(parent)}" if parent else "SELECT sum(t) AS b FROM leaf"
    on = f"JOIN up USING ({by})" if parent else "CROSS JOIN up"
    part = f"PARTITION BY {by} " if parent else ""
    keys = ", ".join([*parent, column])
    return f"""
{name}_up AS ({up}),
{name}_kids AS (SELECT {keys}, {_case(column, weights)} AS w, sum(t) * {MAX_EPOCHS} AS most FROM leaf GROUP BY {keys}),
{name}_in AS (
  SELECT k.*, up.b AS total,
    up.b - coalesce(sum(most) OVER ({part}ORDER BY most / w::DOUBLE, {column} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
    sum(w) OVER ({part}ORDER BY most / w::DOUBLE, {column} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
  FROM {name}_kids k {on.replace("up", name + "_up up")}),
{name}_flag AS (SELECT *, most * weight > w * remains AS open FROM {name}_in),
{name}_open AS (
  SELECT {by + ", " if parent else ""}arg_max(remains, weight) AS remains, max(weight) AS weight FROM {name}_flag WHERE open {"GROUP BY " + by if parent else ""}),
{name} AS (
  SELECT {keys}, CASE WHEN f.open THEN f.w * o.remains // o.weight ELSE most END AS b
  FROM {name}_flag f LEFT JOIN {name}_open o {f"USING ({by})" if parent else "ON true"})"""


def parent_table(parent: list[str]) -> str:
    return {1: "by_domain", 2: "by_lang"}[len(parent)]


ORACLE = rf"""
WITH rows_ AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(['{"', '".join(DOMAINS)}'][TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT) % {len(DOMAINS)} + 1], 'other') AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS t FROM rows_ GROUP BY ALL),
{_level("by_domain", [], "domain", WEIGHTS[0])},
{_level("by_lang", ["domain"], "lang", WEIGHTS[1])},
{_level("by_source", ["domain", "lang"], "source", WEIGHTS[2])},
plan AS (
  SELECT s.*, CASE WHEN t > 0 THEN b // t ELSE 0 END AS "full", CASE WHEN t > 0 THEN b % t ELSE 0 END AS rest
  FROM by_source s JOIN leaf USING (domain, lang, source)),
dealt AS (
  SELECT r.*, p."full", p.rest,
    sum(tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('{SEED}:' || p."full"::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows_ r JOIN plan p USING (domain, lang, source)),
chosen AS (
  SELECT *, CAST("full" + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INT) AS epochs FROM dealt)
SELECT doc_id, domain, lang, source, tokens, epochs FROM chosen WHERE epochs > 0
"""
