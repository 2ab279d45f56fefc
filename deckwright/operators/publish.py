"""Immutable publication: results under an identity of their inputs, checked before a pointer turns to them.

A store is a folder that Spark can write.  Each attempt writes a run's tables to a folder of its own, and what was
written is what gets hashed, checked and published; the manifest row, which names the folder, is written last, so a
run without one was never published.  The pointer is an append-only log of (format, run),
of which the latest entry holds; a writer names the entry that it expects to replace.  The log has a few rows a
publication.  One writer at a time is assumed, as the store's file system may have no lock.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import validate

LOG = "sequence long, format string, run_id string, at timestamp, action string"
RUN = "run_id string, content string, manifest string, folder string, at timestamp"


def canonical(value: object) -> bytes:
    """The one spelling of a small JSON value that identities hash."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def identity(kind: str, inputs: object) -> str:
    return f"{kind}-{hashlib.sha256(canonical(inputs)).hexdigest()}"


def content_hash(df: DataFrame) -> str:
    """Of all rows, whatever their order: digests are added up, so that nothing is gathered."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    row = df.agg(F.count("*").alias("n"), *part).first()
    return hashlib.sha256(canonical([row["n"], *(str(row[f"s{i}"]) for i in range(4))])).hexdigest()


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:  # the folder is made by the first write
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return self._read("published", RUN)

    def log(self) -> DataFrame:
        return self._read("pointer", LOG)

    def active(self) -> DataFrame:
        """(format, run_id): the latest entry of each format."""
        last = F.row_number().over(Window.partitionBy("format").orderBy(F.desc("sequence")))
        return self.log().withColumn("n", last).where("n = 1 AND run_id IS NOT NULL").select("format", "run_id")

    def table(self, run_id: str, name: str) -> DataFrame:
        """Only of published runs."""
        run = self.runs().where(F.col("run_id") == run_id).first()
        if run is None:
            raise LookupError(f"{run_id} is not published")
        return self.spark.read.parquet(f"{run['folder']}/{name}")

    def publish(self, inputs: object, tables: Mapping[str, DataFrame], checks: Mapping[str, DataFrame]) -> str:
        """Writes a run once: the same inputs with the same results are the run that is there, with others an
        error.  Nothing is published while a check has rows."""
        run_id = identity("run", inputs)
        folder = f"{self.path}/runs/{run_id}/{uuid.uuid4().hex}"
        counts, digests = {}, {}
        for name, df in tables.items():  # computed once: a table that isn't deterministic is hashed as it was written
            df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
            written = self.spark.read.parquet(f"{folder}/{name}")
            counts[name], digests[name] = written.count(), content_hash(written)
        content = hashlib.sha256(canonical(digests)).hexdigest()
        if (known := self.runs().where(F.col("run_id") == run_id).first()) is not None:
            if known["content"] != content:
                raise ValueError(f"{run_id} is published with other results")
            return run_id
        validate.require(checks) if checks else None
        row = (run_id, content, canonical({"inputs": inputs, "rows": counts}).decode(), folder, datetime.now(timezone.utc))
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        return run_id

    def _turn(self, fmt: str, run_id: str | None, expected: str | None, action: str) -> None:
        now = self.active().where(F.col("format") == fmt).first()
        if (now["run_id"] if now else None) != expected:
            raise ValueError(f"the active run of {fmt} is not {expected}")
        sequence = (self.log().agg(F.max("sequence")).first()[0] or 0) + 1
        self.spark.createDataFrame([(sequence, fmt, run_id, datetime.now(timezone.utc), action)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")

    def activate(self, fmt: str, run_id: str, expected: str | None) -> None:
        self.table_exists(run_id)
        self._turn(fmt, run_id, expected, "activate")

    def rollback(self, fmt: str, expected: str) -> str:
        """Back to the run that was active before this one."""
        entries = self.log().where((F.col("format") == fmt) & (F.col("run_id") != expected)).orderBy(F.desc("sequence")).first()
        if entries is None:
            raise ValueError(f"{fmt} has no run before {expected}")
        self._turn(fmt, entries["run_id"], expected, "rollback")
        return entries["run_id"]

    def table_exists(self, run_id: str) -> None:
        if not self.runs().where(F.col("run_id") == run_id).limit(1).count():
            raise LookupError(f"{run_id} is not published")
