"""Files: folder walks, lists, change logs, and the choice among them."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import columns as c
from lodestone.operators import crawl
from lodestone.sources import journal, progress


FOUND = "path string, size long, mtime double"


def plain_path(path: Column) -> Column:
    """A local file's path without its scheme, and without the escapes of a URI."""
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def escaped(path: str) -> str:
    """A name that a reader doesn't take for a pattern."""
    return re.sub(r"([\\{}\[\]*?^])", r"\\\1", path)


def _status(spark: SparkSession, path: str):
    """(file system, Path) of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _status(spark, path)
    return fs.exists(at)


def _row(status) -> tuple[str, int, float]:
    return re.sub("^file:(//)?(?=/)", "", status.getPath().toString()), status.getLen(), status.getModificationTime() / 1000


def stat(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """path, size, mtime of the named files (path) that exist, empty ones too; nothing else is listed."""
    out = []
    for r in paths.select("path").distinct().toLocalIterator():
        fs, at = _status(spark, r["path"])
        try:
            found = fs.getFileStatus(at)
        except Py4JJavaError:
            continue
        if found.isFile():
            out.append((r["path"], *_row(found)[1:]))
    return spark.createDataFrame(out, FOUND)


def _readable(spark: SparkSession, tops: list[str]) -> list[tuple[str, int, float]]:
    """A walk folder by folder that passes over what can't be read."""
    out, todo = [], [*tops]
    while todo:
        fs, at = _status(spark, todo.pop())
        try:
            below = fs.listStatus(at)
        except Py4JJavaError:
            continue
        for s in below:
            if s.isDirectory():
                todo.append(s.getPath().toString())
            else:
                out.append(_row(s))
    return out


def walk(spark: SparkSession, paths: list[str], excluded: list[str] | None = None) -> DataFrame:
    """path, size, mtime of all files below the folders, or of the files themselves; content isn't read. Folders that are missing or can't be read are passed over."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], FOUND)
    try:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([*map(escaped, there)])
        out = df.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))
    except (Py4JJavaError, PySparkException):
        out = spark.createDataFrame(_readable(spark, there), FOUND)
    return out.filter(~c.in_excluded_dir(F.col("path"), excluded))


def file_list(spark: SparkSession, list_path: str) -> DataFrame:
    """The files that a list names, one a line, blanks and missing ones aside; change is not checked."""
    lines = spark.read.text(list_path).select(F.trim("value").alias("path")).filter("path != ''")
    return stat(spark, lines).withColumn("extension", c.extension(F.col("path"))).withColumn("file_type", c.file_type(F.col("extension"))).filter("file_type IS NOT NULL")


def logged(spark: SparkSession, log_path: str, prefixes: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Files that a change log names and that exist, once each, whatever the action; only these are looked at."""
    paths = crawl.change_log(spark.read.text(log_path)).select("path")
    return stat(spark, (paths.filter(c.under(F.col("path"), prefixes)) if prefixes else paths).filter(~c.in_excluded_dir(F.col("path"), excluded)))


def journaled(spark: SparkSession, volumes: dict[str, journal.Volume], saved: dict[str, dict], prefixes: list[str], excluded: list[str] | None = None) -> tuple[DataFrame, dict[str, dict]] | None:
    """(files that the journals name since the saved offsets and that exist, the offsets to save); None where a walk must make up for a volume without a saved, continuous journal."""
    found, offsets = None, {}
    for name, volume in volumes.items():
        state = volume.state()
        if name not in saved or not journal.continuous(saved[name], state):
            return None
        latest = crawl.latest_changes(journal.since(volume.records(saved[name]["next_usn"]), saved[name]["next_usn"], state["first_usn"]))
        paths = journal.resolved(latest, volume.paths()).select("path")
        found = paths if found is None else found.unionByName(paths)
        offsets[name] = state
    if found is None:
        return None
    return stat(spark, found.filter(c.under(F.col("path"), prefixes) & ~c.in_excluded_dir(F.col("path"), excluded))), offsets


def scan(spark: SparkSession, paths: list[str], files: DataFrame, log_path: str | None = None, max_mb: int = 500, excluded: list[str] | None = None, volumes: dict | None = None, offsets_path: str | None = None) -> DataFrame:
    """New and changed files: from the change log if it has lines, else from the volumes' journals if they are continuous, else by a walk. Without paths, none.

    The journals' offsets are saved once the scan's plan is made, so what is found here is read from them no more.
    """
    if not paths:
        return crawl.changed(crawl.eligible(spark.createDataFrame([], FOUND)), files)
    if log_path and exists(spark, log_path) and spark.read.text(log_path).head(1):
        disk = logged(spark, log_path, paths, excluded)
    elif volumes and offsets_path and (got := journaled(spark, volumes, progress.load_offsets(offsets_path), paths, excluded)):
        disk, offsets = got
        for name, state in offsets.items():
            progress.save_offsets(offsets_path, name, state)
    else:
        disk = walk(spark, paths, excluded)
        for name, volume in (volumes or {}).items():  # from here on the journal can go on
            if offsets_path:
                progress.save_offsets(offsets_path, name, volume.state())
    return crawl.changed(crawl.eligible(disk, max_mb), files)


def collect(spark: SparkSession, volumes: dict[str, journal.Volume], offsets_path: str, log_path: str, stamp: str) -> int:
    """The journals' changes since the saved offsets as lines of the change log; their number. A volume without an offset only gets one."""
    total = 0
    for name, volume in volumes.items():
        saved, state = progress.load_offsets(offsets_path).get(name), volume.state()
        if saved and journal.continuous(saved, state):
            rows = journal.since(volume.records(saved["next_usn"]), saved["next_usn"], state["first_usn"])
            said = journal.resolved(rows, volume.paths()).select(F.lit(stamp).alias("ts"), journal.action(F.col("reason")).alias("action"), "path")
            n = said.count()
            if n:
                append_log(said, log_path)
            total += n
        progress.save_offsets(offsets_path, name, state)
    return total


def write_list(changed: DataFrame, to: str) -> None:
    changed.select(F.col("path").alias("value")).write.text(to)


def append_log(changes: DataFrame, to: str) -> None:
    """ts, action, path as lines of a log folder."""
    changes.select(F.concat_ws("|", "ts", "action", "path").alias("value")).write.mode("append").text(to)
