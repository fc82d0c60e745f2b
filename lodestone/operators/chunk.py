"""Overlapping chunks that end at the best separator."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from lodestone.functions.fixed import SEPARATORS

CHUNKS = "source_file string, chunk_index int, char_offset int, text string"


def chunks(text: str | None, size: int = 1000, overlap: int = 200) -> Iterator[tuple[int, int, str]]:
    """(index, offset, text). The end is the last place of the first separator that the window's second half has."""
    if not 0 <= overlap < max(1, size / 2):
        raise ValueError("the overlap must be less than half of the size")
    if not text or not text.strip():
        return
    n = len(text)
    if n <= size:
        yield 0, 0, text
        return
    at, index, emitted = 0, 0, None
    while True:
        end = min(at + size, n)
        if end < n:
            found = ((text.rfind(s, at + size // 2, end), len(s)) for s in SEPARATORS)
            end = next((p + k for p, k in found if p >= 0), end)
        if piece := text[at:end].strip():
            yield index, at, piece
            index, emitted = index + 1, at
        if end >= n:
            return
        at = end - overlap if emitted is None or end - overlap > emitted else end


def chunk(docs: DataFrame, path_col: str = "file_path", text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """source_file, chunk_index, char_offset, text: no shuffle, a batch of documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, at, piece in chunks(text, size, overlap):
                    for col, v in zip(cols, (path, i, at, piece), strict=True):
                        col.append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(cols, kinds, strict=True)], names=["source_file", "chunk_index", "char_offset", "text"])

    return docs.select(path_col, text_col).mapInArrow(run, CHUNKS)


@udtf(returnType="chunk_index int, char_offset int, text string")
class ChunkText:
    """The chunker for SQL: register with spark.udtf.register("chunk_text", ChunkText), then LATERAL chunk_text(text, size, overlap)."""

    def eval(self, text: str, size: int, overlap: int):
        yield from chunks(text, size, overlap)
