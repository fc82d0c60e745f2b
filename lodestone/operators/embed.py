"""Embedders. The offline default hashes words into buckets; a model's embedder plugs in by the same protocol."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Dimensions of the default's vectors; words whose buckets a task keeps.
BUCKETS, WORDS = 256, 200_000
_WORD = re.compile("[a-z0-9]+")


class Embedder(Protocol):
    """Texts to unit vectors, in batches."""

    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashedEmbedder:
    """Counts of words by bucket, scaled to length one; the zero vector for a text without a word."""

    dimension = BUCKETS

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            of = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % BUCKETS for w in re.findall("[a-z0-9]+", (t or "").lower()))
            norm = math.sqrt(sum(v * v for v in of.values())) or 1.0
            v = [0.0] * BUCKETS
            for b, n in of.items():
                v[b] = n / norm
            out.append(v)
        return out


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """df with a model's vectors, an Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(texts.fillna("").tolist()))

    return df.withColumn(out_col, run(F.col(text_col)))


def hashed_rows(df: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Sparse vectors, a row each: key, buckets (in order), weights. No shuffle: a text's words are counted where the text is. A text without a word has no row."""
    fields = [f for k in key for f in df.schema if f.name == k]
    schema = T.StructType([*fields, T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, int] = {}
        for b in batches:
            on, buckets, weights = [], [], []
            for i, t in enumerate(b.column(len(key)).to_pylist()):
                if len(of) > WORDS:
                    of.clear()
                counts: Counter = Counter()
                for w, n in Counter(_WORD.findall((t or "").lower())).items():
                    if (k := of.get(w)) is None:
                        k = of[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % BUCKETS
                    counts[k] += n
                if counts:
                    norm = math.sqrt(sum(n * n for n in counts.values()))
                    on.append(i)
                    buckets.append(sorted(counts))
                    weights.append([counts[k] / norm for k in buckets[-1]])
            rows = b.take(pa.array(on, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(i).cast(kinds.field(i).type) for i in range(len(key))), pa.array(buckets, kinds.field("buckets").type), pa.array(weights, kinds.field("weights").type)], schema=kinds)

    return df.select(*key, text_col).mapInArrow(run, schema)


def hashed(df: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """The same, a row for each bucket: key, bucket, w."""
    out = hashed_rows(df, key, text_col).select(*key, F.explode(F.arrays_zip("buckets", "weights")).alias("x"))
    return out.select(*key, F.col("x.buckets").cast("long").alias("bucket"), F.col("x.weights").alias("w"))
