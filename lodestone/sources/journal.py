"""Binary change records: version 2, little-endian, names in UTF-16LE."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import columns as c
from lodestone.functions import fixed

_HEADER = struct.Struct("<IHHQQQQIIIIHH")
HEADER = 60


def records(data: bytes) -> Iterator[tuple[int, int, int, int, int, str, bool]]:
    """(ref, parent, usn, reason, attributes, name, is_directory); records of other versions or with a broken name are passed over."""
    at = 0
    while at + HEADER <= len(data):
        size, major, _, ref, parent, usn, _, reason, _, _, attributes, n, name_at = _HEADER.unpack_from(data, at)
        if size < HEADER or at + size > len(data):
            return
        start = at + name_at
        if major == 2 and start + n <= len(data):
            try:
                yield ref, parent, usn, reason, attributes, data[start : start + n].decode("utf-16-le"), bool(attributes & fixed.DIRECTORY)
            except UnicodeDecodeError:
                pass
        at += size


def record(ref: int, parent: int, usn: int, reason: int, attributes: int, name: str) -> bytes:
    """A record's bytes."""
    raw = name.encode("utf-16-le")
    size = (HEADER + len(raw) + 7) // 8 * 8
    return (_HEADER.pack(size, 2, 0, ref, parent, usn, 0, reason, 0, 0, attributes, len(raw), HEADER) + raw).ljust(size, b"\0")


def decoded(buffers: DataFrame, col: str = "content") -> DataFrame:
    """The journal rows of binary buffers."""
    from decimal import Decimal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for data in b.column(0).to_pylist() if data for r in records(data)]
            cols = [*zip(*rows, strict=True)] if rows else [[]] * 7
            kinds = [pa.decimal128(20, 0)] * 2 + [pa.int64()] * 3 + [pa.string(), pa.bool_()]
            names = ["ref", "parent_ref", "usn", "reason", "attrs", "name", "is_directory"]
            arrays = [pa.array([Decimal(x) for x in col] if i < 2 else col, k) for i, (col, k) in enumerate(zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return buffers.select(col).mapInArrow(run, schemas.JOURNAL)


class Volume(Protocol):
    """A volume's change journal: what an operating system's reader gives, or a folder of saved buffers."""

    def state(self) -> dict:
        """journal_id, first_usn, next_usn."""

    def records(self, usn: int) -> DataFrame:
        """The journal's rows from an offset on."""

    def paths(self) -> DataFrame:
        """ref, path of the files that are there."""


@dataclass
class SavedVolume:
    """A journal whose buffers were saved, one file a page, named by the offset of their first record; its index of paths is a table."""

    spark: SparkSession
    folder: str
    index: DataFrame
    journal_id: int
    first_usn: int
    next_usn: int

    def state(self) -> dict:
        return {"journal_id": self.journal_id, "first_usn": self.first_usn, "next_usn": self.next_usn}

    def records(self, usn: int) -> DataFrame:
        """Pages that end before the offset aren't read: a page ends where the next begins."""
        names = self.spark.read.format("binaryFile").load(self.folder).select("path").collect()  # names alone
        starts = sorted((int(re.search(r"(\d+)[^/]*$", r["path"])[1]), r["path"]) for r in names)
        on = [p for i, (_, p) in enumerate(starts) if i + 1 == len(starts) or starts[i + 1][0] > usn]
        if not on:
            return self.spark.createDataFrame([], schemas.JOURNAL)
        return decoded(self.spark.read.format("binaryFile").load(on).select("content"))

    def paths(self) -> DataFrame:
        return self.index


def saved_volume(spark: SparkSession, folder: str) -> SavedVolume:
    """A folder with pages/, index.parquet (ref, path) and state.json (journal_id, first_usn, next_usn)."""
    state = spark.read.schema("journal_id long, first_usn long, next_usn long").json(f"{folder}/state.json").first()
    index = spark.read.parquet(f"{folder}/index.parquet").select(F.col("ref").cast("decimal(20,0)").alias("ref"), "path")
    return SavedVolume(spark, f"{folder}/pages", index, *state)


def action(reason: Column) -> Column:
    """What a record says of its file, as the change log names it."""
    return F.when(c.reason_has(reason, "delete"), "delete").when(c.reason_has(reason, "create"), "create").when(c.reason_has(reason, "rename_old", "rename_new"), "rename").otherwise("modify")


def since(journal: DataFrame, usn: int, first: int = 0) -> DataFrame:
    """Records from an offset on, no earlier than the first that the journal still has."""
    return journal.filter(F.col("usn") >= max(usn, first))


def resolved(journal: DataFrame, paths: DataFrame) -> DataFrame:
    """journal with the path of each reference (ref, path); gone ones fall out, a device prefix goes."""
    return journal.join(paths.select("ref", F.regexp_replace("path", r"^\\\\\?\\", "").alias("path")), "ref")


def continuous(saved: dict, now: dict) -> bool:
    """Whether reading on from the saved state misses nothing; if not, walk the folders instead."""
    return saved.get("journal_id") == now.get("journal_id") and saved.get("next_usn", -1) >= now.get("first_usn", 0)
