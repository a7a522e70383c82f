"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which of another.

Each text is encoded twice, by a byte-level BPE (A) and a sentencepiece BPE (B).  Places
where tokens of both end cut it into groups; between two neighbouring ends lies one link, a
pair of tokens that overlap there.  A pair's count is the number of documents that hold it.

The identity map (A's id to B's id of the same bytes) is made beforehand.  Pairs on it, which
groups of one token each give, are counted in one vocabulary-length vector per task; only the
pairs of irregular groups are shuffled, first summed over a chunk of documents of about
``CHUNK_BYTES``.  Counts come back chunk by chunk, and each chunk's documents, whose pairs
were written when they were encoded, are scored with them.  To the driver come vectors as
long as A's vocabulary, nothing else.

Texts are cut before each space between two ASCII letters, where no token of either kind
crosses.  Each different unit is encoded and aligned once while it stays in the task's cache;
a document's links are those of its units.  A text without such a place is one unit.

Cases: a null or empty text, or one whose tokens don't give its bytes back, has no tokens:
zeros and an empty string.  Repeated rows are documents of their own; null ids are kept.
Ties for the best count are all best.  Extra columns are ignored.  An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.llm.common import Scratch, read, slices, text_bytes, with_columns

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text bytes of the documents that share one list of pairs.
CHUNK_BYTES = 16 << 20
#: Units and their characters that a task's cache holds; beyond either, it keeps those used most often.
CACHE_UNITS, CACHE_CHARS = 300_000, 8 << 20
#: White space runs from here on are left to the slower library, which has no limit on them.
LONG_SPACE = 10_000
CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
SPACES = re.compile(rf"\s{{{LONG_SPACE}}}")


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokens:
    """A vocabulary's tokens as bytes: ``data[start[i] : start[i] + size[i]]`` is token i."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.data[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[ids] - (end - size), size)]


class Aligner:
    """Both tokenizers, their tokens' bytes and the identity map from A to B."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(a_path)
        self._slow.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letter = spec["model"]["vocab"], _byte_of_letter()
        special = {t["id"]: t["content"] for t in spec["added_tokens"]}
        a = [b""] * (max([*vocab.values(), *special]) + 1)
        for name, i in vocab.items():
            a[i] = special[i].encode() if i in special else bytes(letter[c] for c in name)
        for i, name in special.items():
            a[i] = name.encode()
        ranks = {a[i]: i for i in vocab.values() if i not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab[x + y] for x, y in merges]
        # Ids in the order of the merges are ranks, and a rank encoder gives the same ids in a fraction of the time.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        ranked = made == sorted(set(made)) and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
        self._fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranked else None
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b = [self._b.id_to_piece(i) for i in range(self._b.vocab_size())]
        if any("▁" in name.lstrip("▁") for name in b):
            raise ValueError("a piece has a space mark inside: texts can't be cut at spaces")
        b = [bytes([int(name[3:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", name) else name.replace("▁", " ").encode() for name in b]
        self.a, self.b = Tokens(a), Tokens(b)
        named = {}
        for i, t in enumerate(b):
            named[t] = i  # of a byte piece and a named one with the same bytes, the named one, which comes later
        self.same = np.array([named.get(t, -1) for t in a], np.int64)
        self.a_text, self.b_text = [[np.array([f"{i}{end}" for i in range(len(t))], object) for end in ends] for t, ends in ((a, (",", "|")), (b, (",", ";", "")))]
        # The cache: units by number, the groups as text, n_a, n_b, n_groups, n_links (zeros where bytes differ), uses, and each unit's links.
        self._unit: dict[str, int] = {}
        self._text: list[str] = []
        self._size, self._used = np.zeros((4, 0), np.int64), np.zeros(0, np.int64)
        self._at, self._pair, self._times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _make_room(self) -> None:
        """Drops the less used part of a full cache."""
        units = list(self._unit)  # in order of their numbers
        chars = np.array([len(u) for u in units], np.int64)
        if len(units) <= CACHE_UNITS and chars.sum() <= CACHE_CHARS:
            return
        order = np.argsort(-self._used, kind="stable")
        fits = (np.arange(len(units)) < CACHE_UNITS // 2) & (np.cumsum(chars[order]) <= CACHE_CHARS // 2) & (self._used[order] > 1)
        kept = np.sort(order[fits])
        held = np.diff(self._at)[kept]
        link = np.arange(int(held.sum())) + np.repeat(self._at[kept] - (np.cumsum(held) - held), held)
        self._unit = {units[k]: n for n, k in enumerate(kept.tolist())}
        self._text = [self._text[k] for k in kept.tolist()]
        self._size, self._used = self._size[:, kept], np.zeros(len(kept), np.int64)
        self._at, self._pair, self._times = np.concatenate([[0], np.cumsum(held)]), self._pair[link], self._times[link]

    def _a_ids(self, part: str) -> list[int]:
        if self._fast is None or (len(part) >= LONG_SPACE and SPACES.search(part)):
            return self._slow.encode(part, add_special_tokens=False).ids
        return self._fast.encode_ordinary(part)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all units, each with the unit that every id belongs to."""
        out = []
        for each in ([self._a_ids(" " + u) for u in units], self._b.encode(units, num_threads=1)):
            count = np.array([len(x) for x in each], np.int64)
            out += [np.fromiter(chain.from_iterable(each), np.int64, int(count.sum())), np.repeat(np.arange(len(units)), count)]
        return tuple(out)

    def _learn(self, units: list[str]) -> None:
        """Aligns units that the cache lacks and adds them."""
        n = len(units)
        a, doc_a, b, doc_b = self._encode(units)
        raw, at = text_bytes(pa.array([" " + u for u in units], pa.large_string()))
        good = np.ones(n, bool)
        for ids, doc, tokens in ((a, doc_a, self.a), (b, doc_b, self.b)):
            good &= np.bincount(doc, tokens.size[ids], n).astype(np.int64) == np.diff(at)
        size = np.where(good, np.diff(at), 0)
        keep_a, keep_b, byte = good[doc_a], good[doc_b], np.repeat(good, np.diff(at))
        a, doc_a, b, doc_b = a[keep_a], doc_a[keep_a], b[keep_b], doc_b[keep_b]
        of_byte = np.repeat(np.arange(n), size)
        wrong = np.zeros(n, bool)
        for ids, tokens in ((a, self.a), (b, self.b)):
            wrong[of_byte[tokens.joined(ids) != raw[byte]]] = True
        if wrong.any():
            keep_a, keep_b = ~wrong[doc_a], ~wrong[doc_b]
            a, doc_a, b, doc_b = a[keep_a], doc_a[keep_a], b[keep_b], doc_b[keep_b]
            size = np.where(wrong, 0, size)
        total = int(size.sum())
        ends_a, ends_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        ends_a[np.cumsum(self.a.size[a])] = True
        ends_b[np.cumsum(self.b.size[b])] = True
        ends_a[0] = ends_b[0] = False  # the place before the first token
        end = np.flatnonzero(ends_a | ends_b)  # a link for each
        at_a, at_b = ends_a[end], ends_b[end]
        both = at_a & at_b
        i, j = np.cumsum(at_a) - at_a, np.cumsum(at_b) - at_b
        group = np.cumsum(both) - both
        doc = doc_a[i]
        pair = a[i] * len(self.b.size) + b[j]
        # The groups as text: each id with the sign that follows it.
        g_a, g_b = group[at_a], group[at_b]
        n_groups = int(both.sum())
        of_a, of_b = np.bincount(g_a, minlength=n_groups), np.bincount(g_b, minlength=n_groups)
        before_a, before_b = np.cumsum(of_a), np.cumsum(of_b) - of_b
        last_a, last_b = both[at_a], both[at_b]
        # A token that ends alone isn't its group's last; one that ends with the other kind's is.
        signed = np.empty(len(a) + len(b), object)
        last_a = np.append(g_a[1:] != g_a[:-1], True) if len(a) else last_a
        signed[np.arange(len(a)) + before_b[g_a]] = np.where(last_a, self.a_text[1][a], self.a_text[0][a])
        final = np.append(doc_b[1:] != doc_b[:-1], True) if len(b) else np.zeros(0, bool)
        signed[np.arange(len(b)) + before_a[g_b]] = np.where(final, self.b_text[2][b], np.where(last_b, self.b_text[1][b], self.b_text[0][b]))
        n_a, n_b = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
        stop = np.cumsum(n_a + n_b)
        text = ["".join(signed[s:e].tolist()) for s, e in zip((stop - n_a - n_b).tolist(), stop.tolist(), strict=True)]
        keys, times = np.unique(doc * self.pairs + pair, return_counts=True)
        first = len(self._text)
        self._unit.update(zip(units, range(first, first + n), strict=True))
        self._text += text
        self._used = np.concatenate([self._used, np.zeros(n, np.int64)])
        self._size = np.hstack([self._size, [n_a, n_b, np.bincount(doc[both], minlength=n), np.bincount(doc, minlength=n)]])
        self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(np.bincount(keys // self.pairs, minlength=n))])
        self._pair, self._times = np.concatenate([self._pair, keys % self.pairs]), np.concatenate([self._times, times])

    def align(self, column: pa.Array) -> dict[str, np.ndarray | list]:
        """n_a, n_b, n_groups, n_links and the groups' digest of each text; and its different links (doc, pair, times), in order of both.

        A pair is A's id times B's vocabulary plus B's id."""
        self._make_room()
        units = [CUT.split(t) if t else [] for t in column.to_pylist()]
        new = {u for each in units for u in each}.difference(self._unit)
        if new:
            self._learn(list(new))
        count = np.array([len(x) for x in units], np.int64)
        of = np.fromiter(map(self._unit.__getitem__, chain.from_iterable(units)), np.int64, int(count.sum()))
        self._used += np.bincount(of, minlength=len(self._used))
        n, doc = len(units), np.repeat(np.arange(len(units)), count)
        wrong = np.bincount(doc, self._size[0][of] == 0, n) > 0
        kept = ~wrong[doc]
        of, doc = of[kept], doc[kept]
        sizes = [np.bincount(doc, x[of], n).astype(np.int64) for x in self._size]
        stop = np.cumsum(np.bincount(doc, minlength=n))
        text = self._text
        digest = ["" if s == e else hashlib.sha256(";".join([text[u] for u in of[s:e].tolist()]).encode()).hexdigest() for s, e in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=False)]
        held = self._at[of + 1] - self._at[of]
        link = np.arange(int(held.sum())) + np.repeat(self._at[of] - (np.cumsum(held) - held), held)
        keys, back = np.unique(np.repeat(doc, held) * self.pairs + self._pair[link], return_inverse=True)
        times = np.bincount(back, self._times[link], len(keys)).astype(np.int64)
        return {
            "n_a": sizes[0], "n_b": sizes[1], "n_groups": sizes[2], "n_links": sizes[3], "digest": digest,
            "doc": keys // self.pairs, "pair": keys % self.pairs, "times": times,
        }

    @property
    def pairs(self) -> int:
        return len(self.a.size) * len(self.b.size)


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The task's own copy of both vocabularies, read once for each Python worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


#: kind 0: a document; 1: a chunk's irregular pairs and their numbers of documents; 2: a task's identity vector, as numbers alone.
DOCUMENT, PAIRS, SAME = 0, 1, 2
STORED = "kind int, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, docs array<long>, links binary, times binary"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in STORED.split(", ")]


def _rows(n: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[name], t) if name in columns else pa.nulls(n, t) for name, t in zip(_NAMES, _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _packed(x: np.ndarray, dtype) -> bytes:
    return x.astype(dtype).tobytes()


def stored(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Encodes and aligns every text once; rows as in ``STORED``."""
    with_columns(docs, "doc_id", "text")

    def run(batches):
        model = aligner(a_path, b_path)
        same = np.zeros(len(model.a.size), np.int64)
        held: list[tuple[pa.Array, dict]] = []
        size, chunk = 0, TaskContext.get().partitionId() << 32

        def ended():
            """A chunk's documents refer to its pairs, which are listed once."""
            listed, of = np.unique(np.concatenate([x["pair"] for _, x in held]), return_inverse=True)
            irregular = model.same[listed // len(model.b.size)] != listed % len(model.b.size)
            number = np.bincount(of, minlength=len(listed))
            same[listed[~irregular] // len(model.b.size)] += number[~irregular]
            # Irregular pairs are numbered from 0 in order; a pair on the identity map is -1 less A's id.
            place = np.where(irregular, np.cumsum(irregular) - 1, -1 - listed // len(model.b.size))[of]
            yield _rows(1, kind=[PAIRS], chunk=[chunk], pairs=[listed[irregular]], docs=[number[irregular]])
            at = 0
            for ids, x in held:
                n, cut = len(ids), np.searchsorted(x["doc"], np.arange(len(ids) + 1)) + at
                # By the link's place, so that the numbers' differences are small.
                links, times = [], []
                for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    order = np.argsort(place[s:e], kind="stable")
                    links.append(pa.compress(_packed(np.diff(place[s:e][order], prepend=0), np.int32), "zstd", asbytes=True) if e > s else None)
                    times.append(pa.compress(_packed(x["times"][s - at : e - at][order], np.int32), "zstd", asbytes=True) if e > s else None)
                yield _rows(n, kind=np.full(n, DOCUMENT), chunk=np.full(n, chunk), doc_id=ids, n_a=x["n_a"], n_b=x["n_b"], n_groups=x["n_groups"], n_links=x["n_links"], groups_sha256=x["digest"], links=links, times=times)
                at += len(x["pair"])

        for batch in slices(batches, "text"):
            held.append((batch.column("doc_id"), model.align(batch.column("text"))))
            size += batch.column("text").nbytes
            if size >= chunk_bytes:
                yield from ended()
                held, size, chunk = [], 0, chunk + 1
        if held:
            yield from ended()
        if same.any():
            yield _rows(1, kind=[SAME], docs=[same])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STORED)


def pair_counts(table: DataFrame, size_b: int) -> tuple[DataFrame, DataFrame]:
    """(pair, n) of all irregular pairs, and (a, n) of the identity map, of a table made by ``stored``."""
    irregular = table.where(F.col("kind") == PAIRS).select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))
    same = table.where(F.col("kind") == SAME).select(F.posexplode("docs").alias("a", "docs")).groupBy("a").agg(F.sum("docs").alias("n")).where("n > 0")
    return irregular, same


def best_map(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, n: for each id of A, the ids of B that most documents link it with (ties: all)."""
    scratch = Scratch(docs.sparkSession, "best-map")
    model = aligner(a_path, b_path)
    size_b, same = len(model.b.size), model.same.tolist()
    irregular, regular = pair_counts(scratch.keep(stored(docs, a_path, b_path), "aligned"), size_b)
    mapped = docs.sparkSession.createDataFrame(list(enumerate(same)), "a int, b long")  # as long as A's vocabulary
    counts = irregular.select((F.col("pair") / size_b).cast("int").alias("a"), (F.col("pair") % size_b).alias("b"), "n").unionByName(regular.join(mapped, "a"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return scratch.finish(counts.join(most, "a").where(F.col("n") == F.col("most")).select("a", "b", "n"))


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignments(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "align")
    table = scratch.keep(stored(docs, a_path, b_path, chunk_bytes), "aligned")
    model = aligner(a_path, b_path)
    size_a, size_b = len(model.a.size), len(model.b.size)
    irregular, regular = pair_counts(table, size_b)
    totals = scratch.keep(irregular, "totals")
    same = np.zeros(size_a, np.int64)
    for r in regular.collect():  # at most A's vocabulary, as is the next
        same[r["a"]] = r["n"]
    best = same.copy()
    for r in totals.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("n").alias("n")).collect():
        best[r["a"]] = max(best[r["a"]], r["n"])
    vectors = spark.sparkContext.broadcast((same, best))

    listed = table.where(F.col("kind") == PAIRS).select(F.col("chunk").alias("of_chunk"), F.explode("pairs").alias("pair"))
    counted = listed.join(totals.hint("merge"), "pair").select("of_chunk", "pair", "n")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        same, best = vectors.value
        order = np.argsort(right["pair"].to_numpy())
        n, a = right["n"].to_numpy()[order], right["pair"].to_numpy()[order] // size_b
        is_best, same_best = n == best[a], same == best
        n_best, count_sum = [], []
        for links, times in zip(left["links"].to_pylist(), left["times"].to_pylist(), strict=True):
            if links is None:
                n_best.append(0)
                count_sum.append(0)
                continue
            place, times = np.cumsum(_unpacked(links)), _unpacked(times)
            first = int(np.searchsorted(place, 0))  # from here on irregular pairs
            at, more, rest, rest_times = -1 - place[:first], times[:first], place[first:], times[first:]
            n_best.append(int(more[same_best[at]].sum() + rest_times[is_best[rest]].sum()))
            count_sum.append(int((more * same[at]).sum() + (rest_times * n[rest]).sum()))
        return pa.table([*(left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), left["groups_sha256"]], names=[x.split()[0] for x in OUT.split(", ")])

    rows = table.where(F.col("kind") == DOCUMENT).select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times")
    return scratch.finish(rows.groupBy("chunk").cogroup(counted.groupBy("of_chunk")).applyInArrow(score, OUT))


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), np.int32).astype(np.int64)


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignments(read(spark, sf_dir, "documents"), public_tokenizers.path(A), public_tokenizers.path(B))
