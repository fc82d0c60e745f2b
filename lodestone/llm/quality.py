"""Document quality by a factorisation machine.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum takes linear time as
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). The features x are hashed words (1 + log count, scaled to unit
length) and structure statistics and metadata that follow from the text: its length, lines, classes of characters,
repetition. Every word of the whole text counts. The model is fitted by minibatch Adam on a bounded sample of labelled
rows, those of the least hash of their id (``sample`` is the bound); it has a fixed size and is all that tasks are sent.

Null and empty texts have the score of the empty text. Without labelled rows, or with one class alone, the score is the
share of ones with a prior of a half. An id with unlike labels teaches nothing; of several texts of an id the one of least
hash does. Repeated rows get equal scores. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import per_batch, slices, small_batches, trim

#: Buckets of hashed words, factors of each feature; texts that are scored at once.
BUCKETS, FACTORS, AT_ONCE = 1 << 12, 8, 256

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASSES = {
    "space": np.flatnonzero(_SPACE),
    "digit": np.arange(0x30, 0x3A),
    "upper": np.arange(0x41, 0x5B),
    "lower": np.arange(0x61, 0x7B),
    "high": np.arange(0x80, 0x100),
    "stop": np.array([0x21, 0x2C, 0x2E, 0x3F]),
    "shout": np.array([0x21]),
    "bar": np.array([0x7C, 0x3C, 0x3E, 0x7B, 0x7D]),
    "sign": np.array([0x23, 0x24, 0x25, 0x26, 0x2A, 0x40, 0x5C, 0x5E, 0x5F, 0x7E]),
}
STRUCTURE = [*_CLASSES, "length", "words", "mean_word", "distinct", "top_word", "same_as_before", "lines", "mean_line", "distinct_lines", "entropy", "empty"]
_buckets: dict[bytes, int] = {}


def bucket(word: bytes) -> int:
    if (b := _buckets.get(word)) is None:
        if len(_buckets) > 50_000:
            _buckets.clear()
        b = _buckets[word] = zlib.crc32(word) % BUCKETS
    return b


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, their values, structure statistics) of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    at = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    count = Counter(words)
    m = max(1, len(words))
    share = at[at > 0] / n
    stats = [*(at[c].sum() / n for c in _CLASSES.values())]
    stats += [np.log1p(len(data)), np.log1p(len(words)), (len(data) - at[_SPACE].sum()) / m, len(count) / m, max(count.values(), default=0) / m]
    stats += [sum(map(bytes.__eq__, words, words[1:])) / m, np.log1p(len(lines)), np.log1p(len(data) / len(lines)), len({*lines}) / len(lines)]
    stats += [float(-(share * np.log2(share)).sum()), float(not words)]
    of: Counter = Counter()
    for w, k in count.items():
        of[bucket(w.lower())] += k
    where = np.fromiter(of.keys(), dtype=np.int64, count=len(of))
    value = 1 + np.log(np.fromiter(of.values(), dtype=np.float64, count=len(of)))
    return where, value / max(1e-9, np.sqrt((value**2).sum())), np.array(stats)


@dataclass
class Machine:
    """w0, w, v over words, then structure statistics, which are scaled by mean and spread."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def row(self, where: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.clip((stats - self.mean) / self.spread, -5, 5) / np.sqrt(len(stats))
        return np.concatenate([where, BUCKETS + np.arange(len(stats))]), np.concatenate([value, scaled])

    def logit(self, i: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[i] * x[:, None]
        return float(self.w0 + self.w[i] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum()))

    def logits(self, made: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of several rows at once: one sum over all of their features, parted where a row begins."""
        i, x = (np.concatenate([m[k] for m in made]) for k in (0, 1))
        at = np.cumsum([0, *(len(m[0]) for m in made)])[:-1]
        vx = self.v[i] * x[:, None]
        total = np.add.reduceat(vx, at)
        return self.w0 + np.add.reduceat(self.w[i] * x, at) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), at))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = [self.logits([self.row(*features(t)) for t in texts[at : at + AT_ONCE]]) for at in range(0, len(texts), AT_ONCE)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(z), -500, 500))) if z else np.zeros(0)


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Minibatch Adam on the logistic loss."""
    size, rng = BUCKETS + len(STRUCTURE), np.random.default_rng(seed)
    ones = float((labels.sum() + 1) / (len(labels) + 2))
    m = Machine(float(np.log(ones / (1 - ones))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), np.zeros(len(STRUCTURE)), np.ones(len(STRUCTURE)))
    if not len(labels) or labels.min() == labels.max():
        m.v[:] = 0
        return m
    stats = np.array([r[2] for r in rows])
    m.mean, m.spread = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    made = [m.row(*r) for r in rows]
    p, state, t = np.concatenate([m.w[:, None], m.v], axis=1), [np.zeros((size, FACTORS + 1)) for _ in range(2)], 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            i, x = (np.concatenate([made[k][j] for k in ids]) for j in (0, 1))
            lengths = np.array([len(made[k][0]) for k in ids])
            start = np.cumsum(lengths) - lengths
            vx = p[i, 1:] * x[:, None]
            total = np.add.reduceat(vx, start)
            z = m.w0 + np.add.reduceat(p[i, 0] * x, start) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), start))
            off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[ids]
            each = np.repeat(off, lengths)[:, None] / len(ids)
            slope = np.concatenate([each * x[:, None], each * x[:, None] * (np.repeat(total, lengths, axis=0) - vx)], axis=1)
            g = np.zeros_like(p)
            np.add.at(g, i, slope)
            g += decay * p
            t += 1
            state[0] += 0.1 * (g - state[0])
            state[1] += 0.001 * (g**2 - state[1])
            p -= rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
            m.w0 -= rate * off.mean()
    m.w, m.v = p[:, 0].copy(), p[:, 1:].copy()
    return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000) -> Machine:
    """A machine fitted on at most ``sample`` rows of docs that labels (id, label) covers."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1)")
    chosen = chosen.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select("id", "y")
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)  # sample rows of two numbers: a proven size

    def f(rows: dict) -> dict:
        found = [features(t) for t in rows["text"]]
        return {"id": rows["id"], "h": rows["h"], "y": rows["y"], "i": [x[0] for x in found], "x": [x[1].astype(np.float32) for x in found], "s": [x[2] for x in found]}

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h")).join(F.broadcast(chosen), "id")
    # an id that several rows have counts once; what comes to the driver is at most sample rows of at most BUCKETS values
    rows = per_batch(texts, "id long, h long, y int, i array<int>, x array<float>, s array<double>", f)
    rows = rows.groupBy("id").agg(F.min_by(F.struct("y", "i", "x", "s"), "h").alias("r")).select("id", "r.*").toArrow().sort_by("id")
    made = [(np.asarray(i, dtype=np.int64), np.asarray(x, dtype=np.float64), np.asarray(s)) for i, x, s in zip(*(rows[c].to_pylist() for c in "ixs"), strict=True)]
    return fit(made, np.asarray(rows["y"].to_pylist(), dtype=np.float64))


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every row."""

    def f(rows: dict) -> dict:
        return {"id": rows["id"], "score": machine.scores(rows["text"])}

    return per_batch(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id long, score double", f).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score below the threshold; all columns stay, and no row is looked up by its id."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            yield b.filter(pa.array(machine.scores(b.column(names.index(text_col)).to_pylist()) >= threshold, pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)
