"""Exact deduplication by composable polynomial fingerprints.

A text, with each run of ASCII white space made one space, is hashed in chunks. A chunk's hash is its bytes as the
coefficients of a polynomial, at two bases modulo 2^31-1; the hash of a concatenation is
``left * base^len(right) + right``, so chunks hash in any order and combine in pairs. Texts of equal fingerprint and length are then compared chunk by chunk with their
group's first row; only texts that share a fingerprint are shuffled for that.

Null text counts as empty; empty texts form a group of their own. Ties go to the smallest id; null ids come last. An empty
table gives an empty result. Other columns, of any name, are not read. Rows that repeat an id are rows of their own: they
are known by id and text. exact_groups() has a line for each of them; of rows that agree in id and text exact_dedup()
keeps one, any of them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, cut, keyed, per_batch, split_by, stored, without

PRIME = (1 << 31) - 1
BASES = (1_000_003, 914_279_681)
CHUNK = 1 << 16
#: Members of a group that are compared in one task with a copy of the group's first text.
MEMBERS = 256

_RUN = re.compile(SPACE.replace(b"+", b"{2,}") + rb"|[\x09-\x0D]")
_powers: dict[int, np.ndarray] = {}


def normal(text: str | None) -> bytes:
    """UTF-8 of text with every run of ASCII white space made one space."""
    return _RUN.sub(b" ", (text or "").encode("utf-8", "surrogatepass"))


def powers(base: int) -> np.ndarray:
    """base^(CHUNK-1) ... base^0 modulo PRIME."""
    if base not in _powers:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < CHUNK:  # base^0.. doubled: the second half is the first times base^len
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
        _powers[base] = np.ascontiguousarray(out[:CHUNK][::-1])
    return _powers[base]


def chunk_hash(chunk: bytes) -> tuple[int, int, int]:
    """(length, hash at each base). Zero bytes count as one, so leading ones are not lost."""
    b = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return len(chunk), *(int((b * powers(x)[CHUNK - len(b) :]).sum() % np.uint64(PRIME)) for x in BASES)  # products < 2^40, so 2^16 of them fit


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The hash of two parts, from theirs: the left is shifted by the right's length."""
    n = right[0]
    return left[0] + n, *((x * pow(base, n, PRIME) + y) % PRIME for x, y, base in zip(left[1:], right[1:], BASES, strict=True))


def fingerprint(data: bytes, chunk: int = CHUNK) -> tuple[int, int]:
    """(62-bit fingerprint, length) of data, from the hashes of its chunks: neighbours combine until one is left."""
    parts = [chunk_hash(data[at : at + chunk]) for at in range(0, len(data), chunk)] or [(0, 0, 0)]
    while len(parts) > 1:
        parts = [combine(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0][1] << 31 | parts[0][2], parts[0][0]


def _prints(rows: dict) -> dict:
    texts = [normal(t) for t in rows["text"]]
    found = [fingerprint(t) for t in texts]
    return {k: rows[k] for k in ("row", "print", "id")} | {"fp": [x[0] for x in found], "n": [x[1] for x in found], "sha": [hashlib.sha256(t).hexdigest() for t in texts]}


def _chunks(rows: dict) -> dict:
    names = ("keep", "keep_print", "row", "print")
    out: dict[str, list] = {k: [] for k in (*names, "salt", "part", "chunk")}
    for i, text in enumerate(rows["text"]):
        data = normal(text)
        first = (rows["row"][i], rows["print"][i]) == (rows["keep"][i], rows["keep_print"][i])
        for part, at in enumerate(range(0, len(data), CHUNK)):
            for s in range(rows["salts"][i]) if first else [rows["salt"][i]]:
                for k in names:
                    out[k].append(rows[k][i])
                for k, v in (("salt", s), ("part", part), ("chunk", data[at : at + CHUNK])):
                    out[k].append(v)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, print, id, fp, n (bytes), sha of every row."""
    return per_batch(keyed(docs, id_col, text_col), "row long, print long, id long, fp long, n long, sha string", _prints)


def differing(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The members (row, print, keep, keep_print, size) whose text isn't that of their group's first row, compared chunk by chunk; large groups are salted, with a copy of the first text for each salt."""
    salts = F.ceil(F.col("size") / F.lit(MEMBERS)).cast("int")
    dealt = cut(members.withColumns({"salts": salts, "salt": F.pmod(F.xxhash64("row", "print"), salts).cast("int")}).drop("size").distinct())
    texts = split_by(keyed(docs, id_col, text_col).drop("id"), dealt, ["row", "print"])[0]
    texts = stored(texts.join(dealt, ["row", "print"]).dropDuplicates(["row", "print"]))  # a row that is repeated is like itself
    schema = "keep long, keep_print long, row long, print long, salt int, part int, chunk binary"
    of, first = ["keep", "keep_print", "salt", "part"], F.expr("row = keep AND print = keep_print")
    firsts = per_batch(texts.filter(first), schema, _chunks).select(*of, F.col("chunk").alias("is"))
    others = per_batch(texts.filter(~first), schema, _chunks)
    return others.join(firsts.hint("shuffle_merge"), of).filter(F.col("chunk") != F.col("is")).select("row", "print").distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, print, id, sha, and of each row's group of equal texts keep, keep_print, keep_id (its first row) and size."""
    prints = cut(fingerprints(docs, id_col, text_col))

    def groups(*key: str) -> DataFrame:
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "row", "print", "id")).alias("first")
        of = prints.groupBy(*key).agg(first, F.count("*").alias("size")).filter("size > 1")
        return cut(of.select(*key, F.col("first.row").alias("keep"), F.col("first.print").alias("keep_print"), F.col("first.id").alias("keep_id"), "size"))

    key = ["fp", "n"]
    several = groups(*key)
    members = prints.filter("n > 0").join(several, key).select("row", "print", "keep", "keep_print", "size")
    if differing(docs, members, id_col, text_col).head(1):  # a collision of fingerprints: part such groups by their digests
        key = ["fp", "n", "sha"]
        several = groups(*key)
    out = prints.join(several, key, "left")
    own = {"keep": "row", "keep_print": "print", "size": None}
    alone = F.col("size").isNull()
    return out.select("row", "print", "id", "sha", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), *(F.coalesce(k, F.col(v) if v else F.lit(1)).alias(k) for k, v in own.items()))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One line per row: id, keep_id, group_size, kept, text_sha256."""
    out = grouped(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("size").cast("long").alias("group_size"), F.col("keep_id").eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row, that of the least id, of each group of equal texts; all columns stay."""
    out = cut(grouped(docs, id_col, text_col).filter("size > 1"))
    first = F.expr("row = keep AND print = keep_print")
    away = cut(out.filter(~first).select("row", "print").distinct())
    again = cut(out.filter(first).groupBy("row", "print").agg(F.count("*").alias("n")).filter("n > 1").select("row", "print"))
    return without(docs, away, again, id_col, text_col)
