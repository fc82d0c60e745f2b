"""The pipeline, stage by stage."""

import re

import pytest

import corpus_pipeline as cp
from lodestone.llm import pii
from lodestone.llm.common import stored
from pyspark.sql import functions as F
from tests.llm.test_operators import slow_words


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        new = stored(stage(spark, docs, sf))
        assert new.columns == columns
        seen[name] = (docs.toPandas(), new.toPandas())
        docs = new
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    before, after = seen["quality"]
    kept = labels[labels.doc_id.isin(after.doc_id)]
    assert (kept.quality == 1).mean() > 0.9 and set(labels[labels.quality == 1].doc_id) - set(after.doc_id) == set()
    before, after = seen["exact_dedup"]
    norm = before.assign(t=before.text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")))
    assert set(after.doc_id) == set(norm.groupby("t").doc_id.min())
    before, after = seen["near_dedup"]
    sets = {i: {*zip(*(slow_words(t)[k:] for k in range(5)))} or {tuple(slow_words(t))} for i, t in zip(before.doc_id, before.text)}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    gone = set(before.doc_id) - set(after.doc_id)
    assert all(any(near(g, o) for o in sets if o < g or o != g) for g in gone)  # nothing goes but near duplicates
    ids = sorted(after.doc_id)
    left = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if near(a, b)]
    assert not left  # and all of them go
    before, after = seen["private_data"]
    old = {m for r in spark.createDataFrame(before).select(F.explode(pii.entities(F.col("text"))).alias("m")).collect() for m in [r["m"]]}
    assert len(before) == len(after) and old and not any(m in t for m in old for t in after.text)
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert cp.run(spark, sf).count() == packed.count()


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing columns, an empty table: every stage runs and keeps what it should."""
    long_ = " ".join(f"word{i % 997}" for i in range(40_000))
    rows = [(1, "same  text here", "en", "a"), (2, "same text\there", None, None), (2, "same text\there", None, None), (None, "no id at all", "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, long_, "en", "a"), (6, long_ + " end", "en", "c"), (5, "call +1 (555) 234-5678 now", "en", "a"), (7, " \n ", "de", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["id", "row", "print", "node", "keep", "bucket", "bits", "found", "held", "n_entities", "h", "y"]
    docs = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(extra)))
    texts = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect() if r["text"] and r["text"].strip())
    after = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        assert name == "packing" or out.columns == docs.columns
        after[name] = out
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert after["quality"].count() <= len(rows) and after["private_data"].count() == len(rows) and after["packing"].select("doc_id").distinct().count() == 8
    unique = [("1", "same  text here"), ("None", "no id at all"), ("5", long_), ("5", "call +1 (555) 234-5678 now"), ("6", long_ + " end")]
    assert texts(after["exact_dedup"]) == sorted(unique) and after["exact_dedup"].count() == len(unique) + 2  # one empty text, one space
    near = [x for x in unique if x[0] != "6"]
    assert texts(after["near_dedup"]) == sorted(near) and after["near_dedup"].count() == len(near) + 1
    private = {r["text"] for r in after["private_data"].collect()}
    assert None in private and not any("234-5678" in t for t in private if t) and long_ in private


def test_stages_begin_with_memory_given_back(monkeypatch):
    """Executors' heaps and workers stay from stage to stage: each stage asks for what they don't need."""

    def asked(spark):
        raise InterruptedError

    monkeypatch.setattr(cp, "forget", asked)
    for _, stage in cp.STAGES:
        with pytest.raises(InterruptedError):
            stage(None, None, "")
