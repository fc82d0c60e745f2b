"""The catalog: one row a file, mutated by whole-snapshot plans and kept as versioned Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone import schemas


def aligned(rows: DataFrame) -> DataFrame:
    """rows as catalog rows: what they don't name is null, status pending, chunk_count 0."""
    out = []
    for field in T._parse_datatype_string(schemas.FILES).fields:
        default = {"status": F.lit("pending"), "chunk_count": F.lit(0)}.get(field.name, F.lit(None))
        out.append((F.col(field.name) if field.name in rows.columns else default).cast(field.dataType).alias(field.name))
    return rows.select(out)


def last_of_each(rows: DataFrame, key: str = "file_path", pos: str | None = None) -> DataFrame:
    """One row a key, the last by pos; any where there is no pos."""
    if pos is None:
        return rows.dropDuplicates([key])
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), F.col(pos)).alias("r")).select("r.*")


def upsert(files: DataFrame, updates: DataFrame, pos: str | None = None) -> DataFrame:
    """Insert or replace all columns by path."""
    new = last_of_each(updates, pos=pos)
    return files.join(new.select("file_path"), "file_path", "left_anti").unionByName(aligned(new))


def mark_indexed(files: DataFrame, done: DataFrame, now: float) -> DataFrame:
    """done has (file_path, n): indexed, at now, with n chunks and no error; unknown paths are ignored."""
    hit = F.col("_n").isNotNull()
    out = files.join(done.groupBy("file_path").agg(F.max("n").alias("_n")), "file_path", "left")
    new = {"status": F.lit("indexed"), "indexed_at": F.lit(float(now)), "chunk_count": F.col("_n").cast("long"), "error": F.lit(None).cast("string")}
    return out.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}).select(files.columns)


def mark_error(files: DataFrame, failed: DataFrame) -> DataFrame:
    """failed has (file_path, message): status and error change, the rest stays."""
    hit = F.col("_m").isNotNull()
    out = files.join(failed.groupBy("file_path").agg(F.max(F.coalesce("message", F.lit(""))).alias("_m")), "file_path", "left")
    return out.withColumns({"status": F.when(hit, "error").otherwise(F.col("status")), "error": F.when(hit, F.col("_m")).otherwise(F.col("error"))}).select(files.columns)


def remove(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def remove_pending(files: DataFrame) -> DataFrame:
    """The catalog without files that were queued and never got on."""
    return files.filter(F.col("status").isNull() | (F.col("status") != "pending"))


def reset_stuck(files: DataFrame) -> DataFrame:
    return files.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def reset_errors(files: DataFrame, only=None) -> DataFrame:
    """Errors, or those for which the condition holds, are pending again."""
    hit = (F.col("status") == "error") & (F.lit(True) if only is None else F.coalesce(only, F.lit(False)))
    return files.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "error": F.when(hit, F.lit(None).cast("string")).otherwise(F.col("error"))})


def stats(files: DataFrame, stuck_is_pending: bool = False) -> DataFrame:
    """One row, one scan: total, indexed, errors, pending, total_chunks."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    pending = ("pending", "processing") if stuck_is_pending else ("pending",)
    chunks = F.coalesce(F.sum(F.when(F.col("status") == "indexed", F.col("chunk_count"))), F.lit(0)).cast("long")
    return files.agg(F.count("*").alias("total"), of("indexed").alias("indexed"), of("error").alias("errors"), of(*pending).alias("pending"), chunks.alias("total_chunks"))


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


class Table:
    """Versioned Parquet. A version is a numbered file that names the folders of its rows; it is written whole, renamed into
    place, and never changed, so readers see one version throughout, and a writer that comes second fails instead of
    undoing the first. A change is a segment: new rows, and the keys whose older rows are gone.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "file_path"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        top = self._Path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(n for n in names if n.startswith("version-"))

    def _pointer(self) -> dict:
        names = self._versions()
        if not names:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/{names[-1]}").collect()[0][0])  # one line

    def version(self) -> int:
        return self._pointer().get("version", 0)

    def properties(self) -> dict:
        return self._pointer().get("properties", {})

    def read(self, segments: list[dict] | None = None) -> DataFrame:
        """The rows of the newest version, or of the segments that another table's version names."""
        parts = self.segments() if segments is None else segments
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        load = lambda folder: self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")
        gone = [(n, self.spark.read.parquet(f"{self.path}/{p['gone']}")) for n, p in enumerate(parts) if p.get("gone")]
        out = None
        for n, p in enumerate(parts):
            rows = load(p["rows"])
            for m, keys in gone:
                if m > n:
                    rows = rows.join(keys, self.key, "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out.select(self.spark.createDataFrame([], self.schema).columns)

    def segments(self) -> list[dict]:
        return self._pointer().get("segments", [])

    def _write(self, df: DataFrame, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _publish(self, was: dict, segments: list[dict], properties: dict) -> int:
        version = was.get("version", 0) + 1
        line = json.dumps({"version": version, "segments": segments, "properties": was.get("properties", {}) | properties})
        new, to = self._Path(f"{self.path}/next-{uuid.uuid4().hex}"), self._Path(f"{self.path}/version-{version:012d}")
        out = self._fs.create(new)
        out.write(bytearray(line.encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(new, to):
            self._fs.delete(new, False)
            raise Conflict(f"version {version} of {self.path} is there already")
        return version

    def commit(self, df: DataFrame, **properties) -> int:
        """df becomes the next version; its plan may read this one."""
        was = self._pointer()
        return self._publish(was, [{"rows": self._write(df, "rows")}], properties)

    def stage(self, df: DataFrame | None, gone: DataFrame | None) -> list[dict]:
        """The newest version's segments and one more, whose rows come in place of those with a key in gone; for a version to name."""
        segment = {"rows": self._write(df if df is not None else self.spark.createDataFrame([], self.schema), "rows")}
        if gone is not None:
            segment["gone"] = self._write(gone.select(self.key).distinct(), "gone")
        return [*self.segments(), segment]

    def change(self, df: DataFrame | None, gone: DataFrame | None, **properties) -> int:
        """A version with df in place of the rows whose key is in gone. Nothing that is there is written anew; compact() does that."""
        was = self._pointer()
        return self._publish(was, self.stage(df, gone), properties)

    def publish(self, segments: list[dict], **properties) -> int:
        """A version of staged segments."""
        return self._publish(self._pointer(), segments, properties)

    def clear(self) -> int:
        return self.commit(self.spark.createDataFrame([], self.schema))

    def drop(self) -> None:
        self._fs.delete(self._Path(self.path), True)

    def compact(self, partitions: int) -> int:
        return self.commit(self.read().repartition(partitions))

    def vacuum(self, keep: list[dict] | None = None) -> None:
        """Remove the folders that neither the newest version nor ``keep`` names, and the older versions."""
        names = self._versions()
        known = {f for p in [*self.segments(), *(keep or [])] for f in p.values()} | {*names[-1:]}
        for s in self._fs.listStatus(self._Path(self.path)):
            if s.getPath().getName() not in known:
                self._fs.delete(s.getPath(), True)

    def backup(self, to: str) -> None:
        self.read().write.parquet(to)

    def check(self, key: str = "file_path") -> bool:
        """Whether each key stands once and none is null."""
        return not self.read().groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).head(1)


def snapshots_rate(snapshots: DataFrame) -> DataFrame:
    """Deltas, files a second and hours to go, between snapshots (t, indexed, errors, pending) in order of t; snapshots are few."""
    w = Window.partitionBy().orderBy("t")
    out = snapshots.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in ("t", "indexed", "errors")})
    rate = (F.col("d_indexed") + F.col("d_errors")) / F.col("d_t")
    return out.withColumn("rate", rate).withColumn("eta_hours", F.when(F.col("rate") > 0, F.col("pending") / F.col("rate") / 3600))
