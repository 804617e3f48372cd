"""Shared plumbing of the llm operators: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Python works through an Arrow batch in runs of rows of at most this many bytes (one row at least).
RUN_BYTES = 2 << 20
#: The same for operators that hold many 64-bit values for each byte.
HASH_RUN_BYTES = 1 << 19
#: Rows of an Arrow batch, where the session does not say: whole texts of some 100 KB stay within 200 MB.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches of whole texts, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master without such a setting (tests) gets a local folder, which goes with the process;
    on a cluster a folder of one machine would lose tables, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="folioscope-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: a lineage cut that outlives executors.

    The table belongs to the caller, who alone may ``release`` it; what a result still reads stays.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path  # for release()
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of one's own that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents table under sf_dir, in any store that Spark can open."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def byte_sizes(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value of a string array without nulls."""
    import pyarrow.compute as pc

    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def filled(texts: pa.Array) -> pa.Array:
    """Null texts count as empty ones."""
    return texts.fill_null("") if texts.null_count else texts


def runs(sizes: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) whose sizes add up to limit at most, or that are single rows."""
    i, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while i < n:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield i, j
        i = j
    give_back()


def give_back() -> None:
    """Return freed memory of this worker process to the system; its next tasks may be of another kind."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values from a counter and a seed."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def read_from_files(docs: DataFrame) -> bool:
    """Whether docs is a table of Parquet files just as it is read: one relation with places of rows and nothing above it but a choice of columns."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project" and not docs.isStreaming and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.relation().toString().lower()


class Keyed:
    """A table under neutral column names with a unique ``row``, so that any columns can come along and decisions find their rows.

    Rows of a table that is read from files as it is get the place in their file, so nothing is copied
    (``in_files`` says that docs is such a table); any other table is written once with row numbers.
    """

    def __init__(self, docs: DataFrame, in_files: bool = False):
        from pyspark.sql import functions as F

        prepare(docs.sparkSession)
        self.names = docs.columns
        renamed = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(self.names)]
        if in_files:
            place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            self.table = docs.select(*renamed, place.alias("row"))
        else:
            self.table = materialize(docs.select(*renamed, F.monotonically_increasing_id().alias("row")), "keyed")

    def __getitem__(self, name: str):
        from pyspark.sql import functions as F

        return F.col(f"c{self.names.index(name)}").alias(name)

    def select(self, *names: str) -> DataFrame:
        """row and the named columns."""
        return self.table.select("row", *(self[n] for n in names))

    def restored(self, joined: DataFrame, **changed) -> DataFrame:
        """The columns of the original, some of them changed, from a join with the table."""
        from pyspark.sql import functions as F

        return joined.select(*(changed.get(c, F.col(f"c{k}")).alias(c) for k, c in enumerate(self.names)))


def free_name(name: str, taken: set[str]) -> str:
    """name, with underscores behind it until it is none of the taken names (in lower case)."""
    while name in taken:
        name += "_"
    return name


def row_type(df: DataFrame) -> str:
    """The type of a table's row column, for schemas of Python operators."""
    return dict(df.dtypes)["row"]


#: A table of one row for each partition of an earlier pass is sent to all executors up to so many rows (24 MB at most).
BROADCAST_ROWS = 1_000_000


def join_bases(big: DataFrame, bases: DataFrame, on: str) -> DataFrame:
    """Join a table of a row or so for each partition: as a broadcast when its counted rows are within bounds, else as any join."""
    from pyspark.sql import functions as F

    return big.join(F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases, on)


#: A written table is sent to all executors up to so many bytes of its files.
BROADCAST_BYTES = 32 << 20


def is_small(written: DataFrame) -> bool:
    """Whether the measured size of a written table lets it, or a part of it, go to all executors."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written.written_to)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() <= BROADCAST_BYTES


def join_measured(big: DataFrame, written: DataFrame, on: str, how: str) -> DataFrame:
    """Join a written table: as a broadcast when its measured size is within bounds, else as any join."""
    from pyspark.sql import functions as F

    return big.join(F.broadcast(written) if is_small(written) else written, on, how)


def prefix_bases(totals: DataFrame, key: str, value: str) -> DataFrame:
    """key, base: the sum of value over all rows of smaller key; totals has one row for each partition of an earlier pass."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(value).over(order), F.lit(0)).cast("long").alias("base"))
