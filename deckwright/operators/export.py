"""Canonical exports: ordered files whose bytes, and so whose digest, are those of the rows, however Spark dealt them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Rows of a file, and digests that one digest is made of.
FILE_ROWS, FANOUT = 10_000, 10_000
#: Bits of monotonically increasing ids that count within a partition.
LOCAL = 33


def canonical(df: DataFrame) -> Column:
    """A row as one line of JSON: columns in order of name, NULLs written out, times in UTC."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false", "timeZone": "UTC"})


def ordered_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    """(ordinal from 0, line) in order of the keys, then of the lines themselves.  Rows are dealt out by ranges of the keys
    and sorted there; a row's place is its place there plus the rows of the ranges before, of which one count each is
    needed.  A key that very many rows share is split by their lines."""
    lines = df.withColumn("line", canonical(df)).select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], "line")
    by = [*[f"key{i}" for i in range(len(keys))], "line"]
    placed = cut(lines.repartitionByRange(*by).sortWithinPartitions(*by).select("line").withColumn("id", F.monotonically_increasing_id()))
    rows = placed.select("line", F.shiftright("id", LOCAL).alias("range"), F.col("id").bitwiseAND(F.lit((1 << LOCAL) - 1)).alias("within"))
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"))  # one row a partition
    starts = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return rows.join(starts, "range").select((F.col("start") + F.col("within")).alias("ordinal"), "line")


def digests(lines: DataFrame, rows: int = FILE_ROWS) -> DataFrame:
    """(part, rows, bytes, sha256) of each stretch of so many lines, every one ended by a line feed."""
    ended = F.struct("ordinal", "line")
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(ended)), lambda x: x["line"]), "\n"), F.lit("\n"))
    each = lines.groupBy(F.floor(F.col("ordinal") / rows).alias("part")).agg(F.count("*").alias("rows"), text.alias("text"))
    return each.select("part", "rows", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


def root(parts: DataFrame, fanout: int = FANOUT) -> str:
    """One digest of (part, sha256): of up to ``fanout`` neighbours together, again until one is left.  That of no rows is
    the digest of nothing."""
    level = parts.select("part", "sha256")
    n = level.count()
    while n > 1:
        level = cut(level.groupBy(F.floor(F.col("part") / fanout).alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda x: x["sha256"]), "\n"), 256).alias("sha256")))
        n = level.count()
    found = level.first()
    return found["sha256"] if found else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def export(df: DataFrame, path: str, keys: list[str], rows: int = FILE_ROWS) -> str:
    """Writes the rows and gives their digest: ``lines/part=n`` with canonical JSON, one file a stretch of so many rows in
    order; ``rows`` with the same as Parquet; and the manifests ``files`` (a row a part), ``columns`` and ``summary``."""
    spark = df.sparkSession
    lines = cut(ordered_lines(df, keys))
    parts = cut(digests(lines, rows))
    whole = root(parts)
    dealt = lines.withColumn("part", F.floor(F.col("ordinal") / rows)).repartition("part").sortWithinPartitions("part", "ordinal")
    dealt.select("part", "line").write.partitionBy("part").text(f"{path}/lines")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(f"{path}/rows")
    parts.write.parquet(f"{path}/files")
    spark.createDataFrame([(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)], "ord int, name string, type string").coalesce(1).write.parquet(f"{path}/columns")
    total = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
    total.withColumn("sha256", F.lit(whole)).coalesce(1).write.parquet(f"{path}/summary")
    return whole


def verified(df_reader: DataFrame, files: DataFrame, rows: int = FILE_ROWS) -> DataFrame:
    """Parts of exported lines (part, value, as Spark reads them back) that don't have the digest that ``files`` has for them.
    Lines of a part are in one file, so their order is that of reading it."""
    placed = df_reader.withColumn("ordinal", F.monotonically_increasing_id()).select("part", "ordinal", F.col("value").alias("line"))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    read = placed.groupBy("part").agg(F.sha2(text, 256).alias("read"))
    return files.join(read, "part", "full").where(~F.col("sha256").eqNullSafe(F.col("read")))
