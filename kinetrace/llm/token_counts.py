"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both encodings must agree.

A huge text is encoded chunk by chunk, each chunk reaching over into the next. Two encodings are spliced at a boundary
that both have, at a place no piece of the vocabulary can span: a space mark after another character, where no piece
holds a space mark after another character. That is checked on the vocabulary; the tokens on each side of such a place
depend only on that side. Where an overlap holds no such common boundary, it is doubled, to the whole text at worst.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm.text import quoted
from kinetrace.plans.shared import shipped

CHUNK = 32_768
OVERLAP = 512
LIMIT = 4096
#: Characters encoded in one call at most, about; it bounds the token ids held at once.
CALL_CHARS = 1_000_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class SpliceCounter:
    """Counts tokens with a SentencePiece model; one a worker process."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import sentencepiece

        self.model, self.chunk, self.overlap = sentencepiece.SentencePieceProcessor(model_file=path), chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        self.splits_at_spaces = not any("▁" in p.lstrip("▁") for p in pieces)

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Where the tokens of text[start:end] begin, in places of the whole text. The model puts a space mark before any input; at a stable start it stands for the space there."""
        start += self.stable(text, start)
        begins = [p.begin for p in self.model.encode(text[start:end], return_type="proto").pieces]
        data = np.frombuffer(text[start:end].encode(), np.uint8)
        characters = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, end - start)  # the model counts in bytes
        return (start + characters[begins]).tolist() if begins else []

    def stable(self, text: str, place: int) -> bool:
        return self.splits_at_spaces and 0 < place < len(text) and text[place] in " ▁" and text[place - 1] not in " ▁"

    def splice(self, text: str, left: list[int], start: int, end: int, right: list[int]) -> int | None:
        """The first common stable boundary inside the overlap of two encodings."""
        theirs = set(right)
        return next((p for p in left if start < p < end and p in theirs and self.stable(text, p)), None)

    def count_long(self, text: str) -> int:
        total, start, overlap = 0, 0, self.overlap
        end = min(len(text), self.chunk)
        left, counted_from = self.boundaries(text, start, end), 0
        while end < len(text):
            start, stop = max(0, end - overlap), min(len(text), end - overlap + self.chunk + overlap)
            right = self.boundaries(text, start, stop)
            place = self.splice(text, left, start, end, right)
            if place is None or place <= counted_from:
                end = min(len(text), end + overlap)
                overlap *= 2
                left = self.boundaries(text, counted_from, end)
                continue
            total += sum(counted_from <= p < place for p in left)
            left, counted_from, end, overlap = right, place, stop, self.overlap
        return total + sum(p >= counted_from for p in left)

    def counts(self, texts: list[str]) -> list[int]:
        out, calls, held = [0] * len(texts), [], 0

        def flush() -> None:
            for i, ids in zip(calls, self.model.encode([texts[i] for i in calls], num_threads=1), strict=True):
                out[i] = len(ids)
            calls.clear()

        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                out[i] = self.count_long(text)
                continue
            calls.append(i)
            held += len(text)
            if held > CALL_CHARS:
                flush()
                held = 0
        if calls:
            flush()
        return out


@lru_cache(maxsize=1)
def counter(path: str) -> SpliceCounter:
    return SpliceCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, text to doc_id, n_bytes, n_tokens, over_limit: one row for each row, in one pass without a shuffle.

    Defined cases: a null or empty text has no bytes and no tokens; strings that look like special tokens are ordinary
    text; rows with equal or null doc_id are counted each; other columns are not looked at.
    """
    path = path or model_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = counter(path)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            n = pa.array(mine.counts(text.to_pylist()), pa.int64())
            yield pa.record_batch([batch.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    mine = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text"))
    return shipped(mine).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_token_counts": op4_token_counts}
ORACLE: dict[str, str] = {}
