"""A Python data source of saved events: folders of pages that a manifest lists and names.

    spark.dataSource.register(SavedEvents)
    pages = spark.read.format("saved_events").load("file:///data/events")

A folder with ``manifest.json`` is one event; any other folder stands for those in it.  Each event is a partition of its
own: its task reads the manifest, checks every file that it lists against its SHA-256 and gives a row for each page.
Files are opened through Arrow's file systems, so a path may be a local one or a URI (``file``, ``s3``, ``gs``, ``hdfs``).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import decode_page

PAGE = r"page-(.+)\.html\Z"
#: ``ord`` is the place in the manifest, ``slug`` the page's name (NULL: a file that is no page), ``rounds`` those of the
#: event's format (NULL: all).
SCHEMA = """event_id string, format string, occurred_on date, rounds array<int>, ord int, file string, sha256 string, bytes bigint,
retrieved_at timestamp, retrieved_at_basis string, slug string, text string"""


def opened(path: str):
    """The file system and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def folders(path: str) -> list[str]:
    """The event folders at a path, in order of name."""
    from pyarrow import fs

    files, root = opened(path)
    root = root.rstrip("/")
    if files.get_file_info(f"{root}/manifest.json").type == fs.FileType.File:
        return [path.rstrip("/")]
    within = sorted(x.base_name for x in files.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory)
    found = [f"{path.rstrip('/')}/{name}" for name in within if files.get_file_info(f"{root}/{name}/manifest.json").type == fs.FileType.File]
    if not found:
        raise ValueError(f"{path} holds no saved event")
    return found


class Folder(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class SavedEvents(DataSource):
    """Pages of saved events; see the module."""

    @classmethod
    def name(cls) -> str:
        return "saved_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return EventReader(self.options["path"])


class EventReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Folder]:
        return [Folder(x) for x in folders(self.path)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        files, root = opened(partition.path)

        def content(name: str) -> bytes:
            with files.open_input_stream(f"{root}/{name}") as stream:
                return stream.read()

        manifest = json.loads(content("manifest.json"))
        # early manifests leave the event to the summary beside them
        event = manifest.get("event") or json.loads(content("summary.json"))["event"]
        day = dt.date.fromisoformat(event["date"])
        about = (event["code"].rsplit("/", 1)[-1], event["format"], day, event.get("constructed_rounds"))
        pages = 0
        for ord_, request in enumerate(manifest["requests"]):
            name = request["raw_file"]
            raw = content(name)
            digest = hashlib.sha256(raw).hexdigest()
            if digest != request["sha256"]:
                raise ValueError(f"{name} does not match its manifest's SHA-256")
            told = request.get("retrieved_at")
            when = dt.datetime.fromisoformat(told) if told else files.get_file_info(f"{root}/{name}").mtime
            page = re.match(PAGE, name)
            pages += page is not None
            yield (*about, ord_, name, digest, len(raw), when, "manifest" if told else "file_mtime", page and page.group(1), page and decode_page(raw))
        if not pages:
            raise ValueError(f"{partition.path} holds no saved pages")


def once(pages: DataFrame) -> DataFrame:
    """The pages; an event that is saved in more than one folder raises.  A folder lists each place once."""
    seen = pages.groupBy("event_id", "ord").agg(F.count("*").alias("n")).where("n > 1")
    twice = seen.select("event_id").distinct().select(F.col("event_id").alias("twice"))
    joined = pages.join(F.broadcast(twice.limit(1_000)), F.col("event_id") == F.col("twice"), "left")
    wrong = F.raise_error(F.concat(F.lit("saved more than once: "), "event_id"))
    return joined.withColumn("event_id", F.when(F.col("twice").isNull(), F.col("event_id")).otherwise(wrong.cast("string"))).drop("twice")


def identities(pages: DataFrame, *more: str) -> DataFrame:
    """(event_id, identity): a hash of what an event's facts come from: its files and their contents, whatever their
    order, its name, day, format and rounds, and ``more`` (versions of readers, the catalogue's snapshot)."""
    files = F.array_sort(F.collect_list(F.struct("file", "sha256")))
    each = pages.groupBy("event_id", "format", "occurred_on", F.to_json(F.struct("rounds")).alias("rounds")).agg(files.alias("files"))
    body = F.to_json(F.struct("event_id", "format", "occurred_on", "rounds", F.array(*[F.lit(x) for x in more]).alias("more"), "files"))
    return each.select("event_id", F.sha2(body, 256).alias("identity"))
