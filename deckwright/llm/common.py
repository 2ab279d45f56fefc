"""What the operators share: reading tables, cutting lineage, joins that broadcast only what is small."""

from __future__ import annotations

import ctypes
import sys
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one (id, few numbers) side that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48_000_000
#: Bytes of text that an Arrow batch is cut to before numpy looks at it.
SLICE_BYTES = 8_000_000
#: Bytes of all training texts of a model.
TRAIN_BYTES = 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows as files in the shared folder ``spark.checkpoint.dir``, so a lost executor costs no rerun of
    what came before."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where that setting is absent, a temporary folder takes its place if
    driver and executors are one process, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="checkpoint-")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if it has at most so many rows and bytes in its text and binary columns
    (measured); else as it is, and the join shuffles.  ``df`` should be cut or cheap, as measuring runs it."""
    wide = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    total = F.lit(0)
    for part in wide:
        total = total + part
    n, size = df.agg(F.count("*"), total).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], how: str, salt_by: str, salts: int = 32) -> DataFrame:
    """``rows`` joined with a much smaller, cut ``few`` on keys that a large share of the rows may have in common:
    without a shuffle if ``few`` is small, else with each key dealt out over ``salts`` tasks."""
    marked = small(few)
    if marked is not few:
        return rows.join(marked, keys, how)
    salt = next(n for i in range(len(rows.columns) + len(few.columns) + 1) if (n := f"salt{i}") not in {c.lower() for c in [*rows.columns, *few.columns]})
    spread = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).join(spread, [*keys, salt], how).drop(salt)


def remainder(column: str, n: int) -> F.Column:
    """crc32 of an id as text, modulo n: the fold a row belongs to."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def sample_per_label(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled rows of either class, the same ones on every run: (doc_id, label)."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    parts = [one.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def training_texts(docs: DataFrame, chosen: DataFrame, max_bytes: int, total_bytes: int = TRAIN_BYTES) -> pa.Table:
    """The chosen ids (a bounded number) with their labels and texts, in order of id.  Texts over ``max_bytes`` are no
    training rows; of rows that share an id the one with the least text is; and beyond ``total_bytes`` of texts, in an
    order that the ids' hashes give, there are no more."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes)
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("so_far", so_far).where(F.col("so_far") <= total_bytes).select("doc_id", "text", "label").toArrow().sort_by([("doc_id", "ascending")])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches with at most ``most`` bytes in a column, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        a = 0
        while a < len(sizes):
            b, total = a, 0
            while b < len(sizes) and (b == a or total + sizes[b] <= most):
                total += sizes[b]
                b += 1
            yield batch.slice(a, b - a)
            a = b


def release() -> None:
    """Gives memory that a task has freed back to the system, as the worker lives on for other tasks and shares
    its executor's memory with others."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``run`` of one group, or of two with one key; what it has freed goes back before the next group."""

    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        release()
        return out

    return two if run.__code__.co_argcount == 2 else one


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, column: str = "text") -> DataFrame:
    """``each`` over bounded slices of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            yield each(batch)
        release()

    return df.mapInArrow(run, schema)


def keep_where(df: DataFrame, each: Callable[[pa.RecordBatch], pa.Array], column: str = "text") -> DataFrame:
    """The rows, with all their columns, for which ``each`` gives true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            yield batch.filter(each(batch))
        release()

    return df.mapInArrow(run, df.schema)
