"""SentencePiece BPE encoding and decoding by the prefix table.

A byte-pair encoding has one last token for each prefix of the text.  ``Pieces.encode`` fills
that table from left to right: an automaton lists the pieces that end at each place, and the
one that may follow the last token of the prefix before it (the two encode to themselves
when joined) is stored.  The ids are then read backwards from the end.

A text is cut where no piece can cross: before a space mark that follows another character,
and around characters that no piece has (they become byte pieces).  Each different part is
encoded once while it stays in the task's cache.  Runs of several space marks are merged
pair by pair instead: their pieces tie in score, where the table's uniqueness doesn't hold.
The decoded text is put together from the ids of the whole text, piece by piece.

Cases: a null or empty text has no ids and decodes to the empty text.  Texts of any length
take time in proportion.  Extra columns are ignored; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.llm.common import read, slices, with_columns

MARK = "▁"
#: Parts of texts in each of a task's two cache generations, and pairs of pieces held.
CACHE, PAIRS = 150_000, 300_000
TOKENIZER = "piece_bpe_32k.model"


class Pieces:
    """The vocabulary of a sentencepiece BPE model with byte fallback, no normalisation and a dummy prefix."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.vocab_size()
        self.byte = [0] * 256
        self.piece: list[str | bytes | None] = [None] * size
        self.rank: dict[str, tuple[float, int]] = {}
        for i in range(size):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(name[1:-1], 16)] = i
                self.piece[i] = bytes([int(name[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.piece[i] = name
                self.rank[name] = (-model.get_score(i), i)
        if any(MARK in name.lstrip(MARK) for name in self.rank):
            raise ValueError("a piece has a space mark inside: texts can't be cut at spaces")
        letters = "".join(sorted({c for name in self.rank for c in name if name in self.rank and len(name) == 1}))
        inner = {c for name in self.rank for c in name} - set(letters)
        if inner:
            raise ValueError("a piece has a character that is no piece")
        self.parts = re.compile(f"[{re.escape(letters)}]+|[^{re.escape(letters)}]")
        self.automaton = ahocorasick.Automaton()
        for name, (_, i) in self.rank.items():
            if self._merged(name) == [i]:  # a piece that merging never makes is no token
                self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self.surface = [p if isinstance(p, bytes) else (p or "").replace(MARK, " ").encode() for p in self.piece]
        self.written = {str(i): x for i, x in enumerate(self.surface)}  # the same by decimal id

    def _merged(self, part: str) -> list[int]:
        """Encoding by repeated merging of the best pair, leftmost first."""
        tokens = list(part)
        while True:
            best, at = None, -1
            for k in range(len(tokens) - 1):
                rank = self.rank.get(tokens[k] + tokens[k + 1])
                if rank is not None and (best is None or rank[0] < best):
                    best, at = rank[0], k
            if at < 0:
                return [self.rank[t][1] for t in tokens]
            tokens[at : at + 2] = [tokens[at] + tokens[at + 1]]

    def _may_follow(self, a: int, b: int) -> bool:
        if len(self._fits) >= PAIRS:
            self._fits.clear()
        known = self._fits[a << 32 | b] = self._merged(self.piece[a] + self.piece[b]) == [a, b]
        return known

    def _table(self, part: str) -> list[int]:
        """Ids of a part whose characters are all pieces, from the table of last tokens."""
        last, sizes, fits = [-1] * len(part), [0] * len(part), self._fits
        for end, (token, size) in self.automaton.iter(part):
            if last[end] < 0:
                before = end - size
                if before >= 0:
                    previous = last[before]
                    if previous < 0:
                        continue
                    may = fits.get(previous << 32 | token)
                    if not (self._may_follow(previous, token) if may is None else may):
                        continue
                last[end], sizes[end] = token, size
        ids, at = [], len(part) - 1
        while at >= 0:
            ids.append(last[at])
            at -= sizes[at]
        return ids[::-1]

    def _part(self, part: str) -> list[int]:
        ids: list[int] = []
        for run in self.parts.findall(part):
            if run[0] not in self.rank:
                ids += [self.byte[b] for b in run.encode()]
            elif MARK + MARK in run:
                marks = len(run) - len(run.lstrip(MARK))
                ids += self._merged(run) if len(run) < 64 else self._long_marks(run, marks)
            else:
                ids += self._table(run)
        return ids

    def _long_marks(self, run: str, marks: int) -> list[int]:
        """A run that starts with many space marks; equal scores merge leftmost first, over a linked list and a heap."""
        import heapq

        tokens, after, before = list(run), list(range(1, len(run) + 1)), list(range(-1, len(run) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(run):
                pair = tokens[k] + tokens[after[k]]
                if pair in self.rank:
                    heapq.heappush(heap, (self.rank[pair][0], k, pair))

        for k in range(len(run) - 1):
            offer(k)
        while heap:
            _, k, pair = heapq.heappop(heap)
            if tokens[k] is None or after[k] >= len(run) or tokens[after[k]] is None or tokens[k] + tokens[after[k]] != pair:
                continue
            gone = after[k]
            tokens[k], tokens[gone], after[k] = pair, None, after[gone]
            if after[k] < len(run):
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [self.rank[t][1] for t in tokens if t is not None]

    def encode(self, text: str) -> list[int]:
        return [int(x) for s in self._coded(text) for x in s.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: pieces joined, space marks as spaces, without the dummy prefix; control and unknown ids give none."""
        return self._spelled(map(self.surface.__getitem__, ids))

    @staticmethod
    def _spelled(surfaces) -> str:
        text = b"".join(surfaces).decode(errors="replace")
        return text[1:] if text[:1] == " " else text

    def _coded(self, text: str) -> list[str]:
        """Ids, joined by commas, of each part of a text."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if MARK + MARK in marked or marked[0] == MARK:
            parts = [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + marked)]
        else:
            parts = marked.split(MARK)
        cache, out = self._cache, []
        for part in parts:  # without the mark that starts each
            found = cache.get(part)
            if found is None:
                if len(cache) >= CACHE:  # what the last generation didn't meet again goes
                    self._older, self._cache = cache, {}
                    cache = self._cache
                found = self._older.get(part)
                if found is not None:
                    cache[part] = found
                    out.append(found)
                    continue
                found = ",".join(map(str, self._part(MARK + part)))
                if len(part) <= 64:
                    cache[part] = found
            out.append(found)
        return out

    def coded(self, text: str) -> tuple[str, str]:
        """The text's ids joined by commas, and what they decode to."""
        ids = ",".join(self._coded(text))
        return ids, self._spelled(map(self.written.__getitem__, ids.split(","))) if ids else ""


_loaded: dict[str, Pieces] = {}


def pieces(model_file: str) -> Pieces:
    """The task's own copy of the vocabulary, read once for each Python worker."""
    if model_file not in _loaded:
        _loaded[model_file] = Pieces(model_file)
    return _loaded[model_file]


def encode_documents(docs: DataFrame, model_file: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``texts``, also ids (joined by commas) and decoded."""
    with_columns(docs, "doc_id", "text")

    def run(batches):
        model = pieces(model_file)
        for batch in slices(batches, "text"):
            out = [model.coded(x or "") for x in batch.column("text").to_pylist()]
            count = [s.count(",") + 1 if s else 0 for s, _ in out]
            columns = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array([hashlib.sha256(s.encode()).hexdigest() for s, _ in out], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in out], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                columns += [pa.array([s for s, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * texts
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_file: str, column: str = "ids") -> DataFrame:
    """The rows with ``column`` (ids joined by commas; null: none) decoded into a column ``decoded``."""

    def run(batches):
        model = pieces(model_file)
        for batch in slices(batches, column):
            text = [model.decode([int(i) for i in x.split(",")]) if x else "" for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.drop("decoded").mapInArrow(run, encoded.drop("decoded").withColumn("decoded", F.lit("")).schema)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())
