"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and whitespace-normalisation rules: space and \t \n \v \f \r.
SPACE = rb"[\x20\x09-\x0D]+"
#: Rows of a batch that are worked on at once.
AT_ONCE = 512


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session of one machine that names none, as in tests, has a local one; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that later stages don't recompute it and a lost executor loses nothing."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet under the shared folder and read back: a compressed cut() for wide rows. The files go when the application ends."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing holds any more: what they led to has been cut or stored; executors give back the heap that they don't need."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    # a heap grows up to its limit and shrinks in a whole collection alone; Python's workers need their room beside it
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def trim() -> None:
    """A worker gives back the memory that it no longer uses: it stays for later tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library that has none
        pass


def unstored(df: DataFrame) -> None:
    """Deletes the files of a table from stored() that nothing reads any more; Spark drops the shuffles that led there with the plans that are collected."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    forget(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(conf).delete(where, True)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most AT_ONCE rows: what Python makes of their texts is all that it holds."""
    for at in range(0, batch.num_rows, AT_ONCE):
        yield batch.slice(at, AT_ONCE)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python AT_ONCE at a time: the JVM and Python both hold a batch, and texts are wide. A session that asks for fewer keeps its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= AT_ONCE:
        spark.conf.set(name, str(AT_ONCE))


def per_batch(df: DataFrame, schema: str, f: Callable[[dict[str, list]], dict[str, object]]) -> DataFrame:
    """mapInArrow with f from a batch's columns, as lists, to the output's columns, in the order of schema."""
    from pyspark.sql.types import _parse_datatype_string

    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out = f({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[k.name], type=k.type) for k in kinds], schema=kinds)
        trim()

    return df.mapInArrow(run, schema)


#: Bits of the map by which split_by() parts rows: 8 MB, whatever the input.
BITS = 1 << 26


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that df has no column of."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """row, print, id, text: row and print name a row by its id and text, where ids are null or repeated as well."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
    return rows.select(F.coalesce("id", F.lit(0)).alias("row"), F.xxhash64("id", "text").alias("print"), *rows.columns)


def split_by(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of df that may have a key of keys, rows that have none), by a map of BITS bits of the keys' hashes.

    It keeps wide rows that a join can't touch out of its shuffle. The first part has all rows with a key and, as the map
    fills, others as well, so the join still has to be made on it.
    """
    bit = F.pmod(F.xxhash64(*on), F.lit(BITS))
    bucket, bits = unused(df, "bucket"), unused(df, "bits")
    maps = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias(bits))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = df.withColumn(bucket, F.bitmap_bucket_number(bit)).join(F.broadcast(cut(maps)), bucket, "left")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return tuple(marked.filter(x).drop(bucket, bits) for x in (hit, ~hit))


def without(docs: DataFrame, away: DataFrame, again: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows of the keys (row, print) in away; of those in again, which repeat a row, one stays."""
    row, print_ = unused(docs, "row"), unused(docs, "print")
    marked = docs.withColumns({row: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), print_: F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))})
    near, rest = split_by(marked, away.unionByName(again).toDF(row, print_), [row, print_])
    near = near.join(away.toDF(row, print_), [row, print_], "left_anti")
    if again.head(1):
        once = again.toDF(row, print_)
        near = near.join(once, [row, print_], "left_anti").unionByName(near.join(once, [row, print_], "left_semi").dropDuplicates([row, print_]))
    return rest.unionByName(near).select(docs.columns)


def crc_fold(column: str, modulus: int):
    """crc32 of the id as text, modulo: the fixed folds of the contracts."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))
