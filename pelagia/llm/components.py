"""Connected components of a graph given as links, by label propagation with pointer jumping.

Each round is joins and map-side-combined aggregates: the side with a hot key
is only ever the larger side of a sort-merge join, which AQE can split, or goes
through a partial aggregate. Each round's labels are written to the shared
folder, so lineage stays short and a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    Links are pairs of longs, in any direction, repeats allowed; nodes without
    a link don't appear. No links give an empty table.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()
    both = written(
        pairs.select(F.col("lo").alias("node"), F.col("hi").alias("peer")).unionByName(
            pairs.select(F.col("hi").alias("node"), F.col("lo").alias("peer"))
        ),
        "links",
    )
    labels = written(
        both.groupBy("node").agg(F.min("peer").alias("m")).select("node", F.least("node", "m").alias("label")), "labels"
    )
    while True:
        of_peer = labels.select(F.col("node").alias("peer"), F.col("label").alias("peer_label"))
        heard = both.join(of_peer.hint("merge"), "peer").groupBy("node").agg(F.min("peer_label").alias("m"))
        # hooking: a node's root learns of smaller labels too, so long chains halve each round
        lower = labels.join(heard, "node").select("node", "label", F.least("label", "m").alias("low"))
        lower = written(lower, "lower")
        roots = lower.where("low < label").groupBy("label").agg(F.min("low").alias("root_low"))
        hooked = lower.join(
            roots.select(F.col("label").alias("node"), "root_low"), "node", "left"
        ).select("node", F.col("label").alias("was"), F.least("low", F.coalesce("root_low", "low")).alias("label"))
        hooked = written(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        nearer = written(
            hooked.join(jump.hint("merge"), "label").select("node", "was", F.least("label", "further").alias("label")), "labels"
        )
        if not nearer.where("label <> was").limit(1).count():
            return nearer.select("node", "label")
        labels = nearer.select("node", "label")
