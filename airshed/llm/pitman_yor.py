"""Language-model scoring with a hierarchical Pitman-Yor model.

Every token is a dish served in the restaurant of its context, the word before it in its document
(the end token before the first one): counts of pairs of neighbours are gathered over all training texts.
All context restaurants share a parent, the restaurant of words without context.  Its base
measure spells words byte by byte: the restaurants of two-byte contexts share the one-byte
contexts as parents, those share the context-free one, and that one the uniform measure.  A
table of a restaurant is a customer of its parent.

Seatings are sampled by Gibbs: in every sweep all customers of every dish, in the contexts'
restaurants and in their parent, are seated anew, given the parent's probabilities.  Only
the number of tables counts for the rest of the model, so that is what is drawn, at once: exactly,
but for dishes of over 1024 customers and 100 tables, which are drawn by a saddle point.  Dishes are dealt over the cluster; the totals they share are brought up to date
after every sweep.  The samples' predictive probabilities are averaged.  As in the base
score, all words that training lacks are one type: its probability is what the base measure
has left beside the known words, times the weights of new tables.

How it runs: texts are encoded once, in chunks of about ``CHUNK_BYTES`` of text, each with a
word list of its own.  Words and pairs are told apart by 64-bit hashes.  A chunk's pairs are sorted by
their hashes and dealt out in ranges of them, so that numbers come back in that order, without keys; the ranges add up
the chunks' counts.  Sweeps run over the pairs that occur twice or more (a single one always has one table) and the words;
their results go back to the chunks by the same ranges, which add them up for each document.  The driver
holds totals and the spelling model: at most 257 ** 3 counts.

Cases: a null or empty text is the end token alone.  A null doc_id is never held out.
Repeated rows are rows of their own, in training too.  Extra columns are ignored.  An empty
table gives an empty result; without training rows every word is the one unknown type.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.llm.common import BYTE, SPACE, RangeHash, Scratch, Words, mix, read, remainder, slices, text_bytes, with_columns

FOLD = (7, 2)
CHUNK_BYTES = 16 << 20
#: Sweeps before the first sample, samples averaged.
BURN_IN, SAMPLES = 1, 3
STRENGTH = 1.0
MARKERS, CLASSES = 256, 4
SYMBOLS = 257  # the bytes and the word's end; as context, 256 is the word's start
END = 256
LOWER = np.frombuffer(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"), np.uint8)
ROWS = 50_000

CHUNKS = "chunk long, doc_id array<long>, held array<boolean>, size array<long>, tokens binary, words binary"


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def _unpack(x: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, kind)


def _lines(words: pa.Array) -> bytes:
    """The words, joined by line ends."""
    raw, at = text_bytes(words.view(pa.large_string()))
    out = np.full(len(raw) + len(words) - 1, 10, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(len(words)), np.diff(at))] = raw
    return out.tobytes()


def encode(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of documents as word numbers, with the chunk's words (the end token first, as the empty word)."""
    with_columns(docs, "doc_id", "text")
    m, r = FOLD

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", chunk_bytes):
            held = batch.column("held").to_pylist()
            raw, length, size = [], [np.zeros(1, np.int64)], []  # the end token first, then after every document
            for piece in slices([batch], "text"):
                found = Words(piece.column("text"), hashes=False)
                raw.append(LOWER[found.raw[~SPACE[found.raw]]])
                length.append(np.insert(found.end - found.start, found.at[1:], 0))
                size += (np.diff(found.at) + 1).tolist()
            raw, length = np.concatenate(raw), np.concatenate(length)
            of = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
            flat, words = of.indices.to_numpy()[1:], _lines(of.dictionary)
            del found, raw, of
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([size], pa.list_(pa.int64())), pa.array([_pack(flat)], pa.binary()), pa.array([_pack(words)], pa.binary())],
                names=["chunk", "doc_id", "held", "size", "tokens", "words"],
            )
            n += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id"), m) == r, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNKS)


def _opened(batches):
    """(chunk, words, tokens, size, token is in training) of the chunks, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            size = row.column("size").flatten().to_numpy()
            training = np.repeat(~row.column("held").flatten().to_numpy(zero_copy_only=False).astype(bool), size)
            yield row.column("chunk")[0].as_py(), _unpack(row.column("words")[0].as_py()).split(b"\n"), _unpack(row.column("tokens")[0].as_py(), np.int32), size, training


def _frequent(batches):
    """(word, n): all words of each chunk's training tokens, without the end token."""
    for _, words, tokens, _, training in _opened(batches):
        counts = np.bincount(tokens[training], minlength=len(words)).astype(np.int64)
        counts[0] = 0
        for at in range(0, len(words), ROWS):
            n = counts[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + ROWS], pa.binary()), pa.array(n)], names=["word", "n"]).filter(pa.array(n > 0))


def _followers(markers: dict[bytes, int]):
    """(pair, n): how often a marker is the next one after another in a training document."""

    def run(batches):
        for _, words, tokens, size, training in _opened(batches):
            marker = np.fromiter((markers.get(w, -1) for w in words), np.int64, len(words))[tokens]
            at = np.flatnonzero((marker >= 0) & training)
            document = np.repeat(np.arange(len(size)), size)[at]
            next_to = document[1:] == document[:-1]
            pair, n = np.unique(marker[at][:-1][next_to] * MARKERS + marker[at][1:][next_to], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return run


def cluster(counts: np.ndarray, classes: int) -> np.ndarray:
    """Classes of the markers by spectral clustering of the symmetric counts of neighbours."""
    m = len(counts)
    if m <= classes:
        return np.arange(m)
    weight = counts + counts.T
    np.fill_diagonal(weight, 0)  # a word that repeats says nothing of the others
    weight += max(weight.mean(), 1e-9)  # holds markers of few documents to the rest
    scale = 1 / np.sqrt(weight.sum(axis=1))
    _, vectors = np.linalg.eigh(weight * scale[:, None] * scale[None, :])
    rows = vectors[:, -classes:]
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    centres = rows[[0]]  # the most frequent marker, then those farthest from all centres
    for _ in range(classes - 1):
        centres = np.vstack([centres, rows[[np.argmin((rows @ centres.T).max(axis=1))]]])
    for _ in range(20):
        mine = np.argmax(rows @ centres.T, axis=1)
        centres = np.stack([rows[mine == k].mean(axis=0) if (mine == k).any() else centres[k] for k in range(classes)])
    return np.argmax(rows @ centres.T, axis=1)


def marker_classes(chunks: DataFrame) -> dict[bytes, int]:
    """The state (1 to CLASSES) that each marker starts."""
    held = chunks.select("chunk", "held", "size", "tokens", "words")
    top = held.mapInArrow(_frequent, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(MARKERS).collect()
    markers = {bytes(r["word"]): k for k, r in enumerate(top)}
    pairs = held.mapInArrow(_followers(markers), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most MARKERS ** 2
    counts = np.zeros((MARKERS, MARKERS))
    for r in pairs:
        counts[r["pair"] // MARKERS, r["pair"] % MARKERS] = r["n"]
    classes = cluster(counts[: len(markers), : len(markers)], CLASSES) if markers else []
    return {w: int(c) + 1 for w, c in zip(markers, classes, strict=True)}


def pairs(words: list[bytes], tokens: np.ndarray) -> np.ndarray:
    """Each token's (preceding word, word) as one number.  A document starts after the end token, which also ends the one before it."""
    return np.r_[0, tokens[:-1]].astype(np.int64) * len(words) + tokens


def training_pairs(chunks: DataFrame) -> DataFrame:
    """(before, word, c): how often a word follows another in the training texts."""

    def run(batches):
        for _, words, tokens, _, training in _opened(batches):
            cell, n = np.unique(pairs(words, tokens)[training], return_counts=True)
            names = pa.array(words, pa.binary())
            for at in range(0, len(cell), ROWS):
                some = cell[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(some // len(words))), names.take(pa.array(some % len(words))), pa.array(n[at : at + ROWS].astype(np.int64))], names=["before", "word", "c"])

    rows = chunks.select("chunk", "held", "size", "tokens", "words").mapInArrow(run, "before binary, word binary, c long")
    return rows.groupBy("before", "word").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- pairs and words by ranges of their hashes


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A pair's hash, from those of its words."""
    return mix(before) ^ word


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.concatenate([hashes(pa.array(words[at : at + ROWS], pa.binary())) for at in range(0, len(words), ROWS)])


def _tokens_pairs(words: list[bytes], tokens: np.ndarray):
    """The words' hashes, each token's preceding word and its pair's hash."""
    h, before = word_hashes(words), np.r_[np.zeros(1, tokens.dtype), tokens[:-1]]
    return h, before, pair_keys(h[before], h[tokens])


def _runs(key: np.ndarray) -> np.ndarray:
    """The places where sorted numbers change, their start and end included."""
    return np.flatnonzero(np.r_[[True] * (len(key) > 0), key[1:] != key[:-1], True])


def _order(key: np.ndarray) -> np.ndarray:
    """``argsort`` of hashes by sorting them with their places in their low bits, which is faster; in full where those bits count."""
    low = np.uint64(len(key).bit_length())
    order = (np.sort(key >> low << low | np.arange(len(key), dtype=np.uint64)) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    some = key[order]
    return order if (some[1:] >= some[:-1]).all() else np.argsort(key, kind="stable")


def sorted_pairs(words: list[bytes], tokens: np.ndarray):
    """The words' hashes, each token's preceding word, the chunk's pairs by their hashes, a token of each of them and each token's pair."""
    h, before, key = _tokens_pairs(words, tokens)
    order = _order(key)
    key = key[order]
    runs = _runs(key)
    place = np.empty(len(tokens), np.int64)
    place[order] = np.repeat(np.arange(len(runs) - 1), np.diff(runs))
    return h, before, key[runs[:-1]], order[runs[:-1]], place


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers packed by byte, lowest bytes first: small ones take little room."""
    return _pack(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(x: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(_unpack(x, np.uint8).reshape(8, -1).T).view(kind).ravel()


def bucket_bits(tokens: int, partitions: int) -> int:
    """Ranges of hashes, as a power of two: of about a million pairs at most, and several for each task."""
    return max(1, int(np.ceil(np.log2(max(4 * partitions, tokens / 1e6)))))


PARTS = "bucket int, chunk long, keys binary, n binary"


def _parts(chunk: int, key: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted hashes and their numbers, by ranges."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    columns = [pa.array(bucket[edges[:-1]]), pa.array(np.full(len(cuts), chunk)), pa.array([_planes(np.diff(key[a:b], prepend=np.uint64(0))) for a, b in cuts], pa.binary()), pa.array([_planes(n[a:b]) for a, b in cuts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "keys", "n"])


def pair_parts(bits: int):
    """(bucket, chunk, keys, n): the chunks' pairs and how often each is in training."""

    def run(batches):
        for chunk, words, tokens, _, training in _opened(batches):
            *_, key = _tokens_pairs(words, tokens)
            mine, key = np.sort(key[training]), np.sort(key)
            key, runs = key[_runs(key)[:-1]], _runs(mine)
            n = np.zeros(len(key), np.int64)
            n[np.searchsorted(key, mine[runs[:-1]])] = np.diff(runs)
            yield _parts(chunk, key, n, bits)

    return run


FOUND = "chunk long, bucket int, found binary"


def _held_keys(part: pa.Table):
    """(chunks, hashes of all, rows of each chunk) of a range's parts, in the chunks' order."""
    part = part.sort_by("chunk")
    keys = [np.cumsum(_numbers(x.as_py(), np.uint64)) for x in part.column("keys")]
    return part, np.concatenate(keys), np.array([len(x) for x in keys])


def _back(part: pa.Table, size: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """Numbers found for a range's hashes, as they go back to the chunks."""
    cuts = np.cumsum(size)[:-1]
    split = [np.split(x, cuts) for x in columns]
    found = [_planes(np.concatenate([x[k] for x in split])) for k in range(len(size))]
    return pa.table([part.column("chunk"), part.column("bucket"), pa.array(found, pa.binary())], names=["chunk", "bucket", "found"])


def counted(part: pa.Table) -> pa.Table:
    """For every pair of every chunk in a range: twice its count in all training texts, and 1 more in one of the chunks that count it."""
    part, key, size = _held_keys(part)
    n = np.concatenate([_numbers(x.as_py(), np.int64) for x in part.column("n")])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.r_[True, key[1:] != key[:-1]]
    pair = np.cumsum(new) - 1
    code = 2 * np.add.reduceat(n, np.flatnonzero(new))[pair]
    some = np.flatnonzero(n)
    code[some[np.diff(pair[some], prepend=-1) > 0]] += 1
    out = np.empty_like(code)
    out[order] = code
    return _back(part, size, [out])


def _matched(names: list[str], kind):
    """The numbers of a range's (key, *names) for every hash of every chunk in the range, 0 where it has none."""

    def run(part: pa.Table, rows: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["chunk", "bucket", "found"])
        part, key, size = _held_keys(part)
        mine = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(mine)
        mine = mine[order]
        at = np.minimum(np.searchsorted(mine, key), max(len(mine) - 1, 0))
        found = mine[at] == key if len(mine) else np.zeros(len(key), bool)
        columns = []
        for name in names:
            x = np.zeros(len(key), kind)
            x[found] = rows.column(name).to_numpy()[order][at[found]]
            columns.append(x)
        return _back(part, size, columns)

    return run


def returned(found: DataFrame, name: str) -> DataFrame:
    """(chunk, name): what was found for a chunk, in the order of the ranges."""
    return found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "found"))).alias(name))


def _found(row: pa.RecordBatch, name: str, kind, columns: int = 1) -> np.ndarray:
    """The numbers that came back to a chunk, a row for each column."""
    parts = [_numbers(x.as_py(), kind).reshape(columns, -1) for x in row.column(name).flatten().field("found")]
    return np.concatenate(parts, axis=1) if parts else np.zeros((columns, 0), kind)


def _counted(batches):
    """(row, words, tokens, size, training, code) of the chunks whose pairs are counted."""
    for batch in batches:
        for k, opened in enumerate(_opened([batch])):
            row = batch.slice(k, 1)
            yield row, *opened[1:], _found(row, "counted", np.int64)[0]


def _word_counts(batches):
    """(word, text, c, kinds, ones, single): a chunk's words in training, how many pairs they end, once each, and how many once each they begin."""
    for _, words, tokens, _, training, code in _counted(batches):
        h, before, _, at, _ = sorted_pairs(words, tokens)
        first, once = code & 1 == 1, code == 3
        c, kinds, ones, single = (np.bincount(x, minlength=len(words)) for x in (tokens[training], tokens[at[first]], tokens[at[once]], before[at[once]]))
        texts, h = pa.array(words, pa.binary()), h.view(np.int64)
        for lo in range(0, len(words), ROWS):
            some = slice(lo, lo + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), texts[some], *[pa.array(x[some]) for x in (c, kinds, ones, single)]], names=["word", "text", "c", "kinds", "ones", "single"]).filter(pa.array(c[some] > 0))


def _repeated(batches):
    """(before, word, c): the pairs that occur twice or more in training, each from one chunk."""
    for _, words, tokens, _, _, code in _counted(batches):
        h, before, _, at, _ = sorted_pairs(words, tokens)
        at, c, h = at[(code & 1 == 1) & (code > 3)], code[(code & 1 == 1) & (code > 3)] >> 1, h.view(np.int64)
        for lo in range(0, len(at), ROWS):
            some = at[lo : lo + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(h[before[some]]), pa.array(h[tokens[some]]), pa.array(c[lo : lo + ROWS])], names=["before", "word", "c"])


def repeated_parts(bits: int):
    """(bucket, chunk, keys, n): the chunks' pairs that occur twice or more in training."""

    def run(batches):
        for row, words, tokens, _, _, code in _counted(batches):
            key = np.sort(_tokens_pairs(words, tokens)[2])
            key = key[_runs(key)[:-1]][code > 3]
            if len(key):
                yield _parts(row.column("chunk")[0].as_py(), key, np.zeros(len(key), np.int64), bits)

    return run


def word_parts(bits: int):
    """(bucket, chunk, keys, n): the chunks' words."""

    def run(batches):
        for chunk, words, *_ in _opened(batches):
            key = np.sort(word_hashes(words))
            yield _parts(chunk, key, np.zeros(len(key), np.int64), bits)

    return run


def _bucketed(names: list[str], bits: int):
    """(bucket, key, *names) of words, or of pairs where there is a column ``before``."""

    def run(batches):
        for batch in batches:
            key = batch.column("word").to_numpy().view(np.uint64)
            if "before" in batch.schema.names:
                key = pair_keys(batch.column("before").to_numpy().view(np.uint64), key)
            yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(64 - bits)).astype(np.int32)), pa.array(key.view(np.int64)), *[batch.column(x) for x in names]], names=["bucket", "key", *names])

    return run


# ---------------------------------------------------------------- seating


def first_seating(c: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table sizes, dish of each table): as many tables as c customers open on average when a new one weighs a; all but the first have one customer."""
    t = np.clip(np.rint(1 + a * np.log((a + c) / (a + 1))), 1, c).astype(np.int64)
    t[c == 0] = 0
    dish = np.repeat(np.arange(len(c)), t)
    sizes = np.ones(len(dish), np.int64)
    some = t > 0
    sizes[(np.cumsum(t) - t)[some]] = (c - t + 1)[some]
    return sizes, dish


def reseat(sizes, dish, c, a, d, rng, moves):
    """Gibbs moves one by one, to which ``sample_tables`` is held in the tests: in each, one random customer of every dish of two or more gets up and sits down again.

    c: customers of each dish; a: weight of a new table for each dish; sizes, dish: of each table, ordered by dish."""
    live = np.flatnonzero(c > 1)
    if not len(live):
        return sizes, dish
    for _ in range(moves):
        tables = np.bincount(dish, minlength=len(c))
        first = (np.cumsum(tables) - tables)[live]
        sums = np.cumsum(sizes)
        up = np.searchsorted(sums, sums[first] - sizes[first] + rng.integers(0, c[live]), side="right")
        sizes[up] -= 1
        left = tables[live] - (sizes[up] == 0)
        rest = c[live] - 1 - d * left
        new = rng.random(len(live)) * (a[live] + rest) < a[live]
        weight = np.where(sizes > 0, sizes - d, 0.0)
        sums = np.cumsum(weight)
        at = np.searchsorted(sums, sums[first] - weight[first] + rng.random(len(live)) * rest, side="right")
        at = np.clip(at, first, first + tables[live] - 1)
        at = np.where(sizes[at] > 0, at, first + np.where(sizes[first] > 0, 0, 1))  # rounding may hit an empty table
        sizes[at[~new]] += 1
        gone = sizes > 0
        sizes, dish = np.concatenate([sizes[gone], np.ones(new.sum(), np.int64)]), np.concatenate([dish[gone], live[new]])
        order = np.argsort(dish, kind="stable")
        sizes, dish = sizes[order], dish[order]
    return sizes, dish


def _digamma(x: np.ndarray) -> np.ndarray:
    x, below = x.copy(), np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        below[low] -= 1 / x[low]
        x[low] += 1
    return below + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    x, below = x.copy(), np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        below[low] -= np.log(x[low])
        x[low] += 1
    return below + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _proposal(c: np.ndarray, a: np.ndarray, d: float) -> np.ndarray:
    """The strength of the restaurant whose tables are accepted most often for ``sample_tables``, by bisection; any strength gives exact draws."""
    low, high = np.full(len(c), -d * (1 - 1e-6)), np.maximum(a, d)
    for _ in range(30):
        s = (low + high) / 2
        up = _digamma(s + c) - _digamma(s + 1) < (_digamma(np.maximum(a / d, s / d + 1)) - _digamma(s / d + 1)) / d
        low, high = np.where(up, s, low), np.where(up, high, s)
    return (low + high) / 2


#: Dishes of up to this many customers are drawn from a table of all their weights.
SMALL = 1024
_log_s: dict[float, np.ndarray] = {}


def log_seatings(d: float) -> np.ndarray:
    """log S_d(c, t) for c, t <= SMALL, by S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t); kept for the last few discounts."""
    if d not in _log_s:
        if len(_log_s) >= 4:
            _log_s.clear()
        table = np.full((SMALL + 1, SMALL + 1), -np.inf)
        table[1, 1] = 0.0
        t = np.arange(1, SMALL + 1)
        for c in range(1, SMALL):
            with np.errstate(divide="ignore"):
                table[c + 1, 1:] = np.logaddexp(table[c, :-1], table[c, 1:] + np.log(np.maximum(c - d * t, 0.0)))
        _log_s[d] = table
    return _log_s[d]


def small_tables(c: np.ndarray, a: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes of 2 to SMALL customers: the number at which the weights' running sum passes u of their total."""
    table, out = log_seatings(d), np.ones(len(c), np.int64)
    width = 1 << np.ceil(np.log2(np.maximum(c, 2))).astype(np.int64)  # weights beyond c are 0
    for m in np.unique(width).tolist():
        at = np.flatnonzero(width == m)
        for part in np.array_split(at, -(-len(at) * m // 1_000_000)):  # a bounded number of weights at once
            w = table[c[part], 1 : m + 1] + np.log(a[part])[:, None] * np.arange(1, m + 1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            out[part] = 1 + np.minimum((w < u[part, None] * w[:, -1:]).sum(axis=1), c[part] - 1)
    return out


#: Dishes whose likeliest number of tables is this far from 0 and from their customers are drawn by the saddle point.
FAR = 100


def _ratio(x: np.ndarray, d: float) -> np.ndarray:
    """z f'(z) / f(z) for f(z) = (1 - (1 - z)^d) / d, at z = 1 - exp(-x)."""
    return -np.expm1(-x) * np.exp((1 - d) * x) * d / -np.expm1(-d * x)


def _solved(value: np.ndarray, rising, steps: int = 45) -> np.ndarray:
    """x in [1e-9, 60] at which the rising function passes value, by bisection of log x."""
    low, high = np.full(value.shape, np.log(1e-9)), np.full(value.shape, np.log(60.0))
    for _ in range(steps):
        middle = (low + high) / 2
        up = rising(np.exp(middle)) < value
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return np.exp((low + high) / 2)


def likely_tables(c: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest number of tables and its spread, where the weights' logarithm is level."""

    def slope(x):
        return np.log(-np.expm1(-d * x) / d) + np.log(a) - _digamma(c / _ratio(x, d) + 1)

    x = _solved(np.zeros(len(c)), slope)
    r = _ratio(x, d)
    grown = r * (np.exp(-x) / -np.expm1(-x) + (1 - d) - d * np.exp(-d * x) / -np.expm1(-d * x))
    curve = d * np.exp(-d * x) / -np.expm1(-d * x) * r**2 / (c * np.maximum(grown, 1e-300)) + r / c
    return c / r, 1 / np.sqrt(curve)


def great_tables(c: np.ndarray, a: np.ndarray, d: float, u: np.ndarray, likely: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Tables of dishes of many customers and tables, in time that doesn't grow with either; ``likely`` is their ``likely_tables``.

    S_d(c, t) is c! / t! times the coefficient of z^c in f(z)^t, taken by its saddle point; the running integral over nine
    spreads to either side of the likeliest t is passed by u of the whole.  This is an approximation, measured against
    the exact sums: within 0.001 of their distribution function while the saddle point is off the singularity at z = 1
    (c (1 - z) of 20 or more), within 0.03, or a table in 190 on average, when it is close (many customers, few tables)."""
    out = np.ones(len(c), np.int64)
    mode, spread = likely or likely_tables(c, a, d)
    for part in np.array_split(np.arange(len(c)), -(-len(c) // 500)):
        n, w = c[part, None], a[part, None]
        t = np.clip(mode[part, None] + spread[part, None] * np.linspace(-9, 9, 361), 1.0, n - 1.0)
        x = _solved(n / t, lambda x: _ratio(x, d))
        r = _ratio(x, d)
        grown = r * (np.exp(-x) / -np.expm1(-x) + (1 - d) - d * np.exp(-d * x) / -np.expm1(-d * x))
        log_f, log_z = np.log(-np.expm1(-d * x) / d), np.log(-np.expm1(-x))
        log_w = t * (log_f + np.log(w)) - n * log_z - _log_gamma(t + 1) - 0.5 * np.log(t * np.maximum(grown * np.expm1(x), 1e-300))
        weight = np.exp(log_w - log_w.max(axis=1, keepdims=True))
        sums = np.cumsum((weight[:, 1:] + weight[:, :-1]) * np.diff(t, axis=1), axis=1)
        for k, i in enumerate(part.tolist()):
            out[i] = round(float(np.interp(u[i] * sums[k, -1], np.r_[0.0, sums[k]], t[k])))
    return np.clip(out, 1, c.astype(np.int64))


def uniforms(word: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from the words' hashes, so that a draw doesn't depend on where its word lies."""
    with np.errstate(over="ignore"):
        h = mix(word ^ mix(np.full(1, seed, np.uint64)))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample_tables(c: np.ndarray, a: np.ndarray, d: float, rng, u: np.ndarray | None = None) -> np.ndarray:
    """Tables of each dish, all of its customers seated anew: an exact draw from the weights S_d(c, t) a ** t, S_d being the
    number of seatings of c customers at t tables, each by its product of (size less the discount).

    Dishes of up to SMALL customers are drawn from their weights by the numbers u (by default from rng), larger ones of many
    tables by ``great_tables``.  For larger ones of few tables, draws come from a restaurant of one dish and strength s, whose weights are S_d(c, t) (s + d) .. (s + (t - 1) d), and are
    accepted in the ratio of the two, by its maximum; those that can't be any more are given up.  The customer who opens
    the next table comes after a beta-geometric wait, so such a draw costs as many steps as it has tables, not customers."""
    few = np.flatnonzero((c > 1) & (c <= SMALL))
    u = rng.random(len(c)) if u is None else u
    drawn = small_tables(c[few], np.maximum(a[few], 1e-300), d, u[few])
    out = np.minimum(c, 1).astype(np.int64)
    out[few] = drawn
    left = np.flatnonzero(c > SMALL)
    c, a = c.astype(np.float64), np.maximum(a, 1e-300)
    if len(left):
        mode, _ = likely_tables(c[left], a[left], d)
        far = (mode >= FAR) & (c[left] - mode >= FAR)
        great, left = left[far], left[~far]
        if len(great):
            out[great] = great_tables(c[great], a[great], d, u[great])
    strength = np.zeros(len(c))
    strength[left] = _proposal(c[left], a[left], d)
    while len(left):
        s, most = strength[left], np.maximum(np.floor((a[left] - strength[left]) / d), 0) + 1
        least = np.log1p(-rng.random(len(left)))  # the logarithm that an accepted draw's ratio reaches
        top = (most - 1) * np.log(a[left] / d) - _log_gamma(s / d + most) + _log_gamma(s / d + 1)
        t, at, ratio, live = np.ones(len(left)), np.ones(len(left)), -top, np.arange(len(left))
        while len(live):
            opens = rng.beta(s[live] + d * t[live], at[live] - d * t[live])
            with np.errstate(divide="ignore", over="ignore"):
                at[live] += np.floor(np.log1p(-rng.random(len(live))) / np.log1p(-opens)) + 1
            live = live[at[live] <= c[left[live]]]
            ratio[live] += np.log(a[left[live]] / (s[live] + d * t[live]))
            t[live] += 1
            live = live[(t[live] <= most[live]) | (ratio[live] >= least[live] - 1e-9)]
        done = ratio >= least - 1e-9
        out[left[done]] = t[done]
        left = left[~done]
    return out


def _draw(c: int, a: float, d: float, s: float, most: float, top: float, rng) -> int:
    """One dish of ``sample_tables`` by rejection, by the same numbers of rng, without arrays of one."""
    while True:
        least = math.log1p(-rng.random()) - 1e-9
        t, at, ratio = 1, 1.0, -top
        while True:
            opens = rng.beta(s + d * t, at - d * t)
            gap, slope = math.log1p(-rng.random()), math.log1p(-opens) if opens < 1 else -math.inf
            at += np.floor(gap / slope) + 1 if slope else math.inf
            if at > c:
                break
            ratio += math.log(a / (s + d * t))
            t += 1
            if t > most and ratio < least:
                break
        if ratio >= least:
            return t


def seat(c: np.ndarray, a: np.ndarray, d: float, hashed: np.ndarray, seed: int) -> np.ndarray:
    """``sample_tables`` by numbers drawn from the dishes' hashes, so that no draw depends on what lies beside its dish."""
    u, out = uniforms(hashed, seed), np.minimum(c, 1)
    many = c > SMALL
    out[~many] = sample_tables(c[~many], a[~many], d, None, u[~many])
    if many.any():
        at = np.flatnonzero(many)
        n, w = c[at].astype(float), np.maximum(a[at], 1e-300)
        mode, spread = likely_tables(n, w, d)
        far = (mode >= FAR) & (n - mode >= FAR)  # those need no other numbers than u
        if far.any():
            out[at[far]] = great_tables(n[far], w[far], d, u[at[far]], (mode[far], spread[far]))
        at, n, w = at[~far], n[~far], w[~far]
        s = _proposal(n, w, d)
        most = np.maximum(np.floor((w - s) / d), 0) + 1
        top = (most - 1) * np.log(w / d) - _log_gamma(s / d + most) + _log_gamma(s / d + 1)
        for i, *dish in zip(at.tolist(), w.tolist(), s.tolist(), most.tolist(), top.tolist(), strict=True):
            out[i] = _draw(int(c[i]), dish[0], d, *dish[1:], np.random.default_rng([seed, int(hashed[i])]))
    return out


def discount(singles: float, doubles: float) -> float:
    return min(max(singles / (singles + 2 * doubles), 0.1), 0.9) if singles + doubles else 0.5


class Spelling:
    """Byte probabilities from the restaurants of contexts of two bytes, one byte and none; built from counts of (a, b, c)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, rng):
        context, symbol = keys // SYMBOLS, keys % SYMBOLS
        self.uniform = 1.0 / SYMBOLS
        levels = [(context, symbol, counts)]
        for _ in range(2):  # parents start with one table for each dish of a child
            context = context % SYMBOLS if len(levels) == 1 else np.zeros_like(context)
            pair, inverse = np.unique(levels[-1][0] % SYMBOLS * SYMBOLS + levels[-1][1] if len(levels) == 1 else levels[-1][1], return_inverse=True)
            levels.append((pair // SYMBOLS, pair % SYMBOLS, np.bincount(inverse, minlength=len(pair)).astype(np.int64)))
            context = levels[-1][0]
        for _ in range(2):  # down from the parents' probabilities, then up with the tables that they cause
            probability = np.full(SYMBOLS, self.uniform)
            out = []
            for k in (2, 1, 0):
                context, symbol, c = levels[k]
                d = discount((c == 1).sum(), (c == 2).sum())
                parent = probability[symbol] if k == 2 else probability[symbol] if k == 1 else probability[context % SYMBOLS, symbol]
                rooms, room = np.unique(context, return_inverse=True)
                size = np.bincount(room, c, len(rooms))
                a = (STRENGTH + d * np.bincount(room, minlength=len(rooms))[room]) * parent
                t = sample_tables(c, a, d, rng)
                total = np.bincount(room, t, len(rooms))
                own = (c - d * t) / (STRENGTH + size[room])
                back = (STRENGTH + d * total) / (STRENGTH + size)
                if k == 2:
                    p = np.full(SYMBOLS, self.uniform) * back[0] if len(back) else np.full(SYMBOLS, self.uniform)
                    p[symbol] += own
                    probability = p
                elif k == 1:
                    p = np.repeat(probability[None, :], SYMBOLS, axis=0)
                    p[rooms] *= back[:, None]
                    p[context, symbol] += own
                    probability = p
                out.append((context, symbol, t))
                if k == 0:
                    self.keys, self.own = keys, own
                    self.back = np.ones(SYMBOLS * SYMBOLS)
                    self.back[rooms] = back
            self.parent = probability
            # Tables of the two-byte contexts are the one-byte contexts' customers, and so on.
            for k in (0, 1):
                context, symbol, _ = levels[k]
                t = out[2 - k][2]
                up = levels[k + 1]
                where = (context % SYMBOLS * SYMBOLS + symbol) if k == 0 else symbol
                at = np.searchsorted(up[0] * SYMBOLS + up[1], where)
                levels[k + 1] = (up[0], up[1], np.bincount(at, t, len(up[0])).astype(np.int64))

    def log_probability(self, words: pa.Array) -> np.ndarray:
        """Natural log of each word's spelling, its end included."""
        key, word = trigrams(words)
        found = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        own = np.where(self.keys[found] == key, self.own[found], 0.0) if len(self.keys) else 0.0
        context = key // SYMBOLS
        p = own + self.back[context] * self.parent[context % SYMBOLS, key % SYMBOLS]
        return np.bincount(word, np.log(p), len(words))


def trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a, b, c) as one number for every byte c of every word and its end, after the two symbols before it, and the word's place."""
    raw, offsets = text_bytes(words.cast(pa.large_binary()).view(pa.large_string()))
    n = np.diff(offsets)
    word = np.repeat(np.arange(len(n)), n + 3)
    symbols = np.full(len(raw) + 3 * len(n), END, np.int64)  # two starts before each word, its end after
    symbols[np.arange(len(raw)) + 3 * np.repeat(np.arange(len(n)), n) + 2] = raw
    key = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
    inside = word[:-2] == word[2:]
    return key[inside], word[2:][inside]


def hashes(words: pa.Array) -> np.ndarray:
    raw, at = text_bytes(words.cast(pa.large_binary()).view(pa.large_string()))
    return RangeHash(BYTE[raw]).of(at[:-1], at[1:])


def _spelled(batches):
    """(key, n): spelling counts, each word as often as it has tables."""
    for batch in batches:
        key, word = trigrams(batch.column("word"))
        t = batch.column("t").to_numpy()
        keys, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, t[word], len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys[n > 0]), pa.array(n[n > 0])], names=["key", "n"])


def spelling(state: DataFrame, seed: int) -> Spelling:
    """The spelling model of a seating; at most SYMBOLS ** 3 counts come to the driver."""
    rows = state.where("t > 0").select("word", "t").mapInArrow(_spelled, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    return Spelling(rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), np.random.default_rng(seed))


def _sum(*columns):
    total = F.coalesce(F.col(columns[0]), F.lit(0))
    for c in columns[1:]:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total.cast("long")


def learn(counts: DataFrame, scratch: Scratch, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 1) -> tuple[DataFrame, DataFrame, list[float], int, int]:
    """Of the pairs (before, word, c) in training: every word's (word, c, size, p1.., b1..), its count, the customers of its
    restaurant, and by sample its probability without context and what its restaurant leaves to that; every pair's (before,
    word, own), its customers less the discounts; the unknown type's probability by sample; training tokens N and words V.

    A pair that occurs once has one table in every seating, so sweeps run over the others."""
    once = (F.col("c") == 1).cast("long")
    words = counts.groupBy("word").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("kinds"), F.sum(once).alias("ones")).withColumn("text", F.col("word"))
    rooms = counts.groupBy(F.col("before").alias("room")).agg(F.sum("c").alias("size"), F.sum(once).alias("single"))
    known, many, d, unknown, n, v = sweeps(words, rooms, counts.where("c > 1"), scratch, burn_in, samples, seed)
    ks = range(1, samples + 1)
    back = [F.coalesce((F.lit(STRENGTH) + F.lit(d) * F.col(f"r{k}")) / (F.lit(STRENGTH) + F.col("size")), F.lit(1.0)).alias(f"b{k}") for k in ks]
    known = known.select("word", "c", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), *[f"p{k}" for k in ks], *back)
    own = many.select("before", "word", (F.col("c") - F.lit(d / samples) * F.col("ts")).alias("own")).unionByName(counts.where("c = 1").select("before", "word", F.lit(1 - d).alias("own")))
    return known, own, unknown, n, v


def _hashed(column: pa.Array) -> np.ndarray:
    """Hashes of words, which may be hashes already."""
    return hashes(column) if pa.types.is_binary(column.type) else column.to_numpy().view(np.uint64)


def sweeps(words: DataFrame, rooms: DataFrame, many: DataFrame, scratch: Scratch, burn_in: int, samples: int, seed: int = 1) -> tuple[DataFrame, DataFrame, float, list[float], int, int]:
    """Of the words (word, text, c, kinds, ones), their restaurants (room, size, single) and the pairs (before, word, c) of two or
    more customers: every word's (word, c, size, p1.., r1..), its count, the customers of its restaurant, and by sample its probability
    without context and its restaurant's tables; every pair's (before, word, c, ts), its customers and the tables of all samples; the
    discount; the unknown type's probability by sample; training tokens N and words V.  Words are texts, or hashes of their texts."""
    ks = range(1, samples + 1)
    words = scratch.keep(words.select("word", "text", "c", "kinds", "ones", F.lit(1).cast("long").alias("t"), *[F.lit(0.0).alias(f"p{k}") for k in ks]), "words")
    rooms = scratch.keep(rooms.select("room", "size", "single", *[F.lit(0).cast("long").alias(f"r{k}") for k in ks]), "rooms")
    many = scratch.keep(many.select("before", "word", "c", F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("ts")), "many")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("kinds") == 1).alias("one"), F.count_if(F.col("kinds") == 2).alias("two"), F.coalesce(F.sum("ones"), F.lit(0)).alias("ones")).first()
    n, v, d, d0 = int(total["n"]), total["v"], discount(total["ones"], many.where("c = 2").count()), discount(total["one"], total["two"])
    key, unknown, held = words.schema["word"].dataType.simpleString(), [], {"words": "words", "rooms": "rooms", "many": "many"}

    def keep(df: DataFrame, name: str, sweep: int) -> DataFrame:
        out = scratch.keep(df, f"{name}{sweep}")
        scratch.drop(held[name])
        held[name] = f"{name}{sweep}"
        return out

    for sweep in range(burn_in + samples):
        k = sweep - burn_in + 1  # the sample, if positive
        fresh0 = STRENGTH + d0 * (words.agg(F.sum("t")).first()[0] or 0)
        model = spelling(words.select(F.col("text").alias("word"), "t"), seed + sweep)
        now = words.join(many.groupBy("word").agg(F.sum("t").alias("_t")), "word", "left").withColumn("_k", _sum("ones", "_t"))

        def parents(batches, model=model, fresh0=fresh0, at=seed + 1000 * sweep):
            for batch in batches:
                if batch.num_rows:
                    c = batch.column("_k").to_numpy()
                    q = np.exp(model.log_probability(batch.column("text")))
                    t = seat(c, fresh0 * q, d0, _hashed(batch.column("word")), at)
                    new = {"t": pa.array(t), "q": pa.array(q)}
                    yield pa.RecordBatch.from_arrays([new.get(name, batch.column(name)) for name in batch.schema.names], names=batch.schema.names)

        past = [f"p{i}" for i in ks if i < k]
        fields = ["word", "text", "c", "ones", "t", *past, "_k", F.lit(0.0).alias("q")]
        kinds = f"word {key}, text binary, c long, ones long, t long, " + "".join(f"{p} double, " for p in past) + "_k long, q double"
        words = keep(now.select(*fields).mapInArrow(parents, kinds), "words", sweep)
        sums = words.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("_k"), F.lit(0)).alias("k"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("q")).first()
        fresh0, whole0 = (STRENGTH + d0 * sums["t"], STRENGTH + sums["k"]) if n else (1.0, 1.0)
        p = (F.col("_k") - F.lit(d0) * F.col("t") + F.lit(fresh0) * F.col("q")) / F.lit(float(whole0))
        tables = rooms.join(many.groupBy(F.col("before").alias("room")).agg(F.sum("t").alias("_t")), "room", "left").withColumn("_r", _sum("single", "_t"))
        if k > 0:
            unknown.append(fresh0 / whole0 * max(1 - sums["q"], 1e-12))
            rooms = keep(tables.withColumn(f"r{k}", F.col("_r")).drop("_t", "_r"), "rooms", sweep)
            tables = rooms.withColumn("_r", F.col(f"r{k}"))
        if sweep + 1 < burn_in + samples:

            def contexts(batches, at=seed + 1000 * sweep + 500, add=int(k > 0)):
                for batch in batches:
                    if batch.num_rows:
                        before, word = batch.column("before"), batch.column("word")
                        c, t, ts, a = (batch.column(x).to_numpy() for x in ("c", "t", "ts", "a"))
                        with np.errstate(over="ignore"):
                            hashed = pair_keys(_hashed(before), _hashed(word))
                        yield pa.RecordBatch.from_arrays([before, word, pa.array(c), pa.array(seat(c, a, d, hashed, at)), pa.array(ts + add * t)], names=["before", "word", "c", "t", "ts"])

            a = (F.lit(STRENGTH) + F.lit(d) * F.col("_r")) * F.col("_p")
            given = many.join(words.select("word", p.alias("_p")), "word").join(tables.select(F.col("room").alias("before"), "_r"), "before")
            many = keep(given.select("before", "word", "c", "t", "ts", a.alias("a")).mapInArrow(contexts, f"before {key}, word {key}, c long, t long, ts long"), "many", sweep)
        else:
            many = many.withColumn("ts", F.col("ts") + F.col("t"))
        words = words.select("word", "text", "c", "ones", "t", *past, *[p.alias(f"p{k}")] * (k > 0))
    known = words.join(rooms.withColumnRenamed("room", "word"), "word", "left")
    return known, many, d, unknown, n, v


def _score(n: int, v: int, d: float, unknown: list[float]):
    samples = len(unknown)

    def run(batches):
        for batch in batches:
            for row, words, tokens, size, _, code in _counted([batch]):
                h, before, _, pair, place = sorted_pairs(words, tokens)
                of = np.empty((1 + 2 * samples, len(words)))
                of[:, np.argsort(h)] = _found(row, "of_words", float, 1 + 2 * samples)
                count, p, r = of[0], of[1 : 1 + samples], of[1 + samples :]
                p[:, count == 0] = np.array(unknown)[:, None]
                b = (STRENGTH + d * r) / (STRENGTH + count)  # a word begins as many pairs as it ends
                c = code >> 1
                tables = np.where(c > 0, float(samples), 0.0)
                tables[c > 1] = _found(row, "of_pairs", np.int64)[0]
                before, word = before[pair], tokens[pair]
                log_p = np.log10((c - d / samples * tables) / (STRENGTH + count[before]) + sum(b[k, before] * p[k, word] for k in range(samples)) / samples)
                at = np.cumsum(size) - size
                base = np.log10((count + 1) / (n + v + 1))
                score = np.add.reduceat(log_p[place], at)
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_id").flatten(), row.column("held").flatten(), pa.array(size), pa.array(np.add.reduceat((count > 0)[tokens].astype(np.int64), at)), pa.array(np.full(len(size), n, np.int64)), pa.array(np.add.reduceat(base[tokens], at)), pa.array(score), pa.array(10 ** np.minimum(-score / size, 300))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return run


def score_documents(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    columns = ["chunk", "held", "size", "tokens", "words"]
    chunks = scratch.keep(encode(docs), "chunks")
    tokens = chunks.select(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = bucket_bits(tokens, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = chunks.select(*columns).mapInArrow(pair_parts(bits), PARTS).groupBy("bucket").applyInArrow(counted, FOUND)
    chunks = scratch.keep(chunks.join(returned(found, "counted").hint("merge"), "chunk"), "counted")
    scratch.drop("chunks")
    # In training, a word is followed by another as often as it occurs (a document's end by the first word of one).
    words = scratch.keep(chunks.select(*columns, "counted").mapInArrow(_word_counts, "word long, text binary, c long, kinds long, ones long, single long").groupBy("word", "text").agg(*[F.sum(x).alias(x) for x in ("c", "kinds", "ones", "single")]), "vocabulary")
    many = chunks.select(*columns, "counted").mapInArrow(_repeated, "before long, word long, c long")
    known, many, d, unknown, n, v = sweeps(words, words.select(F.col("word").alias("room"), F.col("c").alias("size"), "single"), many, scratch, burn_in, samples)
    # What the chunks' words and repeated pairs are given goes back by the ranges.
    of_pairs = chunks.select(*columns, "counted").mapInArrow(repeated_parts(bits), PARTS).groupBy("bucket")
    of_pairs = of_pairs.cogroup(many.select("before", "word", "ts").mapInArrow(_bucketed(["ts"], bits), "bucket int, key long, ts long").groupBy("bucket")).applyInArrow(_matched(["ts"], np.int64), FOUND)
    of_pairs = scratch.keep(of_pairs, "of_pairs")
    numbers = ["c", *[f"p{k + 1}" for k in range(samples)], *[f"r{k + 1}" for k in range(samples)]]
    given = known.select("word", *[F.col(x).cast("double").alias(x) for x in numbers])
    given = given.mapInArrow(_bucketed(numbers, bits), "bucket int, key long, " + ", ".join(f"{x} double" for x in numbers))
    of_words = chunks.select(*columns).mapInArrow(word_parts(bits), PARTS).groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(_matched(numbers, float), FOUND)
    rows = chunks
    for found, name in ((scratch.keep(of_words, "of_words"), "of_words"), (of_pairs, "of_pairs")):
        rows = rows.join(returned(found, name).hint("merge"), "chunk", "left")
    nothing = F.array().cast("array<struct<bucket:int,found:binary>>")
    rows = rows.withColumns({name: F.coalesce(F.col(name), nothing) for name in ("of_words", "of_pairs")})
    out = rows.mapInArrow(_score(n, v, d, unknown), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return scratch.finish(out)


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
