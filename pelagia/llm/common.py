"""What several text operators share: written intermediate tables, Arrow maps, word rules."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text slices of about this many bytes are handled at once inside a Python worker.
SLICE_BYTES = 1 << 20
#: Data goes to Python workers in batches of about this many bytes, where the session doesn't set another size.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session; a temporary folder of this machine
    only where a local master leaves that unset (tests).
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='pelagia-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before this process
            pass


atexit.register(_sweep)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/pelagia-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage: what follows survives lost executors without repeating
    the work before, and a table that is read twice is computed once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let go of the shuffles behind them.

    Spark keeps a shuffle's files until the driver's JVM collects what refers to it, which a long chain of tables may
    never make it do.
    """
    for df in tables:
        spark = df.sparkSession
        for path in df.inputFiles()[:1]:
            folder = path.rsplit("/", 1)[0]
            if any(folder.split("/")[-1] == where.split("/")[-1] for _, where in _written):
                _delete(spark, folder)
    gc.collect()
    SparkSession.active()._jvm.System.gc()


def map_batches(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``rows`` (columns in, columns out) to Arrow batches, cut to slices of bounded size.

    A slice holds SLICE_BYTES of Arrow data or one row, whichever is more, so
    memory follows the longest row and not the batch.
    """
    names = df.columns
    kinds = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = rows({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return arrow_map(df, run, schema)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of BATCH_BYTES (or one row), however long the rows are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


#: Caches of a worker that end with the task that filled them.
TASK_CACHES: list[dict] = []


def give_back() -> None:
    """Return a worker's free memory to the system: workers wait for later tasks beside the executor's heap."""
    for cache in TASK_CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc: nothing to trim
        pass


def pa_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The file of a vocabulary: ``name`` itself if it is a path, else the public one of that name, looked up on the
    machine that reads it."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def whole(text: str) -> F.Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def word_table() -> bytes:
    """Byte table for the alphanumeric word rule: A-Z to lower case, ASCII other than
    letters and digits to space, bytes of other characters as they are."""
    return bytes(
        c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
    )


WORD_BYTES = word_table()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in UTF-8; none for null."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 (bytes.split knows just these six as space)."""
    return text.encode().split() if text else []
