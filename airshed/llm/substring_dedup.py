"""Substring deduplication: seed and extend on winnowed anchors.

A window is ``LENGTH`` consecutive words of a document.  Words covered by a window whose word
sequence also starts earlier (smaller document, or earlier in the same one) are removed.

Seeds.  Every window holds LENGTH - SEED + 1 seeds of SEED words; the one with the least hash
(leftmost of equals) is its anchor, so equal windows have equal anchors.  An anchor serves a
run of neighbouring windows, all inside its context: the words that those windows may cover.

Extending.  Anchors are joined on their hash.  Where an anchor's whole context also occurs
earlier, the match extends over all of its windows: they are settled.  What is left are the
first occurrences of different contexts of one anchor; only for those are the windows
themselves hashed (from the texts, joined by document) and joined, which extends each match
as far to both sides as it goes.  The covered words of a document are its repeats, each
maximal: neighbouring windows are merged into spans.

Hot groups.  A task first joins its own slice of documents: later occurrences in a slice are
settled on the spot, so a context or window costs a row for each slice, however often it
occurs.  An anchor with several contexts in a slice sends one mark instead of all of them;
the contexts themselves are dealt by context.

Cases: null and empty texts have no words; texts of fewer words than a window keep all.
Repeated rows and rows with repeated or null doc_ids are rows of their own, ordered by
(doc_id, nulls last, text hash).  Extra columns are ignored.  Hashes have 128 bits together
(anchor and context, anchor and window).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airshed.llm.common import RangeHash, Scratch, Words, keyed, mix, read, slices

LENGTH, SEED = 20, 6
#: Text bytes whose repeats a task settles on the spot.
SLICE = 4 << 20
SINGLE, MARK, SEVERAL, SETTLED = 0, 1, 2, 3

ANCHORS = "route long, kind byte, anchor long, context long, rid long, at int, low int, high int"
WINDOWS = "anchor long, window long, rid long, at int, settled boolean"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def leftmost_least(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the least of values[i : i + size], leftmost of equals, for every i where that fits."""
    n = len(values) - size + 1
    least, place, width = values, np.arange(len(values)), 1
    while width < size:
        step = min(width, size - width)
        a, b = least[: len(least) - step], least[step:]
        left = a <= b
        least, place = np.where(left, a, b), np.where(left, place[: len(a)], place[step:])
        width += step
    return place[:n]


def _anchors(words: Words) -> dict[str, np.ndarray]:
    """The anchors of a slice: row, place, context's hash, first and last window's start (places within the slice's words)."""
    hashes = RangeHash(words.hash)
    start, end = words.at[:-1], words.at[1:]
    many = np.maximum(end - start - LENGTH + 1, 0)
    if not many.sum():
        return {}
    row = np.repeat(np.arange(len(many)), many)
    window = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
    i = np.arange(len(words) - SEED + 1)
    seeds = hashes.of(i, i + SEED)
    place = leftmost_least(seeds, LENGTH - SEED + 1)[window]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    row, at = row[first], place[first]
    low = np.maximum(start[row], at - (LENGTH - SEED))
    high = np.minimum(end[row], at + LENGTH)
    context = mix(hashes.of(low, high) ^ mix(((at - low) * 64 + high - at).astype(np.uint64)))
    return {"row": row, "at": at, "anchor": seeds[at], "context": context, "low": window[first], "high": window[last]}


def _later(keys: tuple[np.ndarray, ...], rid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, rid, at; whether each in that order has the keys of the one before)."""
    order = np.lexsort((at, rid, *reversed(keys)))
    same = np.ones(len(order), bool)
    for k in keys:
        s = k[order]
        same[1:] &= s[1:] == s[:-1]
    same[:1] = False
    return order, same


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _emit_anchors(batches):
    for batch in slices(batches, "text", SLICE):
        words = Words(batch.column("text"))
        found = _anchors(words)
        if not found:
            continue
        rid = batch.column("rid").to_numpy()[found["row"]]
        base = words.at[found["row"]]
        order, same = _later((found["anchor"], found["context"]), rid, found["at"])
        anchor, context = found["anchor"][order], found["context"][order]
        kind = np.where(same, SETTLED, SINGLE).astype(np.int8)
        firsts = np.flatnonzero(~same)
        group = np.cumsum(np.r_[True, anchor[firsts][1:] != anchor[firsts][:-1]]) - 1
        several = np.bincount(group)[group] > 1
        kind[firsts[several]] = SEVERAL
        route = np.where(kind == SINGLE, anchor, mix(anchor ^ mix(context)))
        settled = kind == SETTLED
        # Settled rows meet nothing any more: they travel by document, without hashes.
        route[settled] = mix(rid[order][settled].view(np.uint64))
        anchor, context = np.where(settled, np.uint64(0), anchor), np.where(settled, np.uint64(0), context)
        place = [(found[x][order] - base[order]).astype(np.int32) for x in ("at", "low", "high")]
        yield pa.RecordBatch.from_arrays([_signed(route), pa.array(kind), _signed(anchor), _signed(context), pa.array(rid[order]), *map(pa.array, place)], names=["route", "kind", "anchor", "context", "rid", "at", "low", "high"])
        marks = np.unique(anchor[firsts[several]])
        zero, none = np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int32)
        yield pa.RecordBatch.from_arrays([_signed(marks), pa.array(np.full(len(marks), MARK, np.int8)), _signed(marks), pa.array(zero), pa.array(zero), *[pa.array(none)] * 3], names=["route", "kind", "anchor", "context", "rid", "at", "low", "high"])


def _emit_windows(batches):
    """Hashes of the windows of the given anchors: asked holds (anchor, low, high) for each document."""
    for batch in slices(batches, "text", SLICE):
        words = Words(batch.column("text"))
        hashes = RangeHash(words.hash)
        asked = batch.column("asked")
        n = np.diff(asked.offsets.to_numpy())
        flat = asked.flatten()
        low, high = flat.field("low").to_numpy().astype(np.int64), flat.field("high").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        many = high - low + 1
        which = np.repeat(np.arange(len(low)), many)
        at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + low[which]
        start = words.at[row[which]] + at
        window = hashes.of(start, start + LENGTH)
        rid, anchor = batch.column("rid").to_numpy()[row[which]], flat.field("anchor").to_numpy()[which]
        order, same = _later((anchor, window), rid, at)
        # Settled rows meet nothing any more: they travel by document, without hashes.
        anchor, window = np.where(same, 0, anchor[order]), np.where(same, mix(rid[order].view(np.uint64)), window[order])
        yield pa.RecordBatch.from_arrays([pa.array(anchor), _signed(window), pa.array(rid[order]), pa.array(at[order].astype(np.int32)), pa.array(same)], names=["anchor", "window", "rid", "at", "settled"])


def _remove(batches):
    """Results of documents with the window runs (low, high) to remove."""
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"), hashes=False)
        raw = words.raw.tobytes()
        digest, removed, spans = [], [], []
        for k, runs in enumerate(batch.column("runs").to_pylist()):
            a, b = words.at[k], words.at[k + 1]
            gone = np.zeros(b - a + 1, np.int64)
            for run in runs or ():
                gone[run["low"]] += 1
                gone[min(run["high"] + LENGTH, b - a)] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
            removed.append(int(gone.sum()))
            keep = np.flatnonzero(~gone) + a
            digest.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist())])).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.at)), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, kind)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed spans (in words) of every document."""
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = keyed(docs, scratch)
    # Anchors met by their hash; those of one slice alone are dropped unless the slice marked them.
    meet = Window.partitionBy("route")
    met = rows.select("rid", "text").mapInArrow(_emit_anchors, ANCHORS).withColumn("meets", F.count(F.when(F.col("kind") <= MARK, 1)).over(meet))
    met = scratch.keep(met.where((F.col("kind") >= SEVERAL) | ((F.col("kind") == SINGLE) & (F.col("meets") > 1))).drop("route", "meets"), "met")
    # Of one context, all but the first occurrence are settled.
    first = Window.partitionBy("anchor", "context").orderBy("rid", "at")
    compared = met.where(F.col("kind") != SETTLED).withColumn("later", F.row_number().over(first) > 1).select("anchor", "rid", "low", "high", "later")
    settled = met.where(F.col("kind") == SETTLED).select(F.lit(0).cast("long").alias("anchor"), "rid", "low", "high", F.lit(True).alias("later"))
    compared = scratch.keep(compared.unionByName(settled), "compared")
    scratch.drop("met")
    # The first ones are extended window by window.
    asked = compared.where(~F.col("later")).groupBy("rid").agg(F.collect_list(F.struct("anchor", "low", "high")).alias("asked"))
    windows = rows.select("rid", "text").join(asked.hint("merge"), "rid").mapInArrow(_emit_windows, WINDOWS)
    same = Window.partitionBy("anchor", "window").orderBy("rid", "at")
    windows = windows.withColumn("later", F.col("settled") | (F.row_number().over(same) > 1))
    runs = compared.where("later").select("rid", "low", "high").unionByName(windows.where("later").select("rid", F.col("at").alias("low"), F.col("at").alias("high")))
    runs = scratch.keep(runs.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "runs")
    scratch.drop("compared")
    return scratch.finish(rows.join(runs.hint("merge"), "rid", "left").select("doc_id", "text", "runs").mapInArrow(_remove, RESULT))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents) t
), windows AS (
  SELECT doc_id, pos, word, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS words FROM w
), judged AS (
  SELECT doc_id, pos, word, len(words) = 20 AND row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, pos) > 1 AS later FROM windows
), covered AS (
  SELECT doc_id, pos, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged
), counted AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN counted USING (doc_id)
"""
