"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with white space runs as one space.  An item
of n characters may be found with up to e = n * ERRORS // 100 edits.  It is split into e + 1
pieces; edits touch at most e of them, so any occurrence holds one piece unchanged.  An
automaton finds the pieces in the whole text; around each hit, Myers' bit-parallel distance
decides (each stretch of neighbouring alignments once).

The test items are a query set against all rows: they are taken in blocks of about
``BLOCK_BYTES``, each block one pass over the documents, so what a task holds is bounded.

Cases: null and empty texts hold nothing.  Items that are null or shorter than ``MIN_CHARS``
identify nothing and are left out; repeated items are each reported.  Extra columns are
ignored by ``matches`` and kept by ``keep_clean``.  Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.llm.common import kept_rows, read, slices, with_columns

ERRORS, MIN_CHARS = 8, 24
BLOCK_BYTES = 2 << 20


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def best_end(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of text (to a prefix, if anchored), and the first end that has it.

    masks: for each character the bits of its places in the pattern of m characters."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for k, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 | anchored, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        if score < best:
            best, end = score, k
    return best, end


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


class Matcher:
    """The items of one block: an automaton of their pieces and what verifying them needs."""

    def __init__(self, items: list[tuple[int | None, str]], errors: int = ERRORS):
        self.items = [(i, t, len(t) * errors // 100) for i, t in ((i, normalised(t)) for i, t in items) if len(t) >= MIN_CHARS]
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _ready(self) -> None:
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, e) in enumerate(self.items):
            cuts = [p * len(text) // (e + 1) for p in range(e + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((k, a))
        self._automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self._automaton.add_word(piece, (len(piece), places))
        self._automaton.make_automaton()
        self._forward = [_masks(t) for _, t, _ in self.items]
        self._back = [_masks(t[::-1]) for _, t, _ in self.items]

    def find(self, text: str | None) -> Iterator[tuple[int | None, int, int, int, int]]:
        """(item id, distance, allowed, start, end) of the best occurrence of every item that the text holds, places in the normalised text."""
        if not self.items:
            return
        if self._automaton is None:
            self._ready()
        text = normalised(text)
        best: dict[int, tuple[int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        for last, (size, places) in self._automaton.iter(text):
            for k, a in places:
                _, item, e = self.items[k]
                stretch = (last + 1 - size - a) // (e + 1)
                if (k, stretch) in done or (k in best and best[k][0] == 0):
                    continue
                done.add((k, stretch))
                low = max(0, stretch * (e + 1) - e)
                part = text[low : max(0, (stretch + 1) * (e + 1) + len(item) + e)]
                distance, end = best_end(self._forward[k], len(item), part)
                if distance > e or (k in best and best[k][0] <= distance):
                    continue
                _, back = best_end(self._back[k], len(item), part[:end][::-1], anchored=True)
                best[k] = (distance, low + end - back, low + end)
        for k, (distance, start, end) in best.items():
            yield self.items[k][0], distance, self.items[k][2], start, end


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The test items in blocks of about block_bytes, dealt by a hash of the item."""
    with_columns(benchmark, "item_id", "text")
    items = benchmark.where(F.length("text") >= MIN_CHARS).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // block_bytes)
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


MATCH = "doc_id long, item_id long, distance int, allowed int, start long, end long"


def matches(docs: DataFrame, benchmark: DataFrame, errors: int = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and test item that it holds: the best occurrence."""
    with_columns(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, block_bytes):
        matcher = Matcher(block, errors)

        def run(batches, matcher=matcher):
            for batch in slices(batches, "text"):
                found = [(d, *hit) for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in matcher.find(x)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "distance", "allowed", "start", "end"])

        hits = rows.mapInArrow(run, MATCH)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCH)


def keep_clean(docs: DataFrame, benchmark: DataFrame, errors: int = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no test item, all columns unchanged."""
    for block in _blocks(benchmark, block_bytes):
        matcher = Matcher(block, errors)
        docs = kept_rows(docs, lambda column, m=matcher: [next(m.find(x), None) is None for x in column.to_pylist()])
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
