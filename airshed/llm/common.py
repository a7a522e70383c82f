"""Helpers shared by the training-data operators.

* ``Scratch``: run-scoped tables in the shared folder of ``spark.checkpoint.dir``,
  deleted once a result no longer needs them.
* ``keyed``: documents with ``rid``, a non-null unique long that sorts as doc_id does.
* ``slices`` / ``Words``: Arrow batches cut to bounded pieces, and vectorised word hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.session import checkpoint_dir

#: Text bytes handled at once inside a Python task; one longer document is handled alone.
SLICE_BYTES = 1 << 20

WHITE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Tables of one operator run under ``spark.checkpoint.dir`` (shared by all executors)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table; cuts the lineage."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Reliable checkpoint of the result, after which the scratch tables go."""
        out = df.checkpoint(eager=True)
        self.drop()
        return out


def with_columns(df: DataFrame, *needed: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def keyed(docs: DataFrame, scratch: Scratch, whole: bool = False) -> DataFrame:
    """(rid, doc_id, text) of every row; with ``whole`` also the row itself, as a struct.

    rid is doc_id where that is unique and never null.  Otherwise the rows are sorted by
    (doc_id, nulls last, text hash), written once, and numbered in that order, so that
    repeated or null ids stay separate rows in a stable order."""
    with_columns(docs, "doc_id", "text")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    if whole:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    d = docs.select(*columns)
    n = d.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids"), F.countDistinct("doc_id").alias("distinct")).first()
    if n["rows"] == n["ids"] == n["distinct"]:
        return d.select(F.col("doc_id").alias("rid"), *d.columns)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.keep(d.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("rid"), *d.columns), "keyed")


def keep_rows(docs: DataFrame, name: str, chosen) -> DataFrame:
    """The rows of docs, all columns, whose rid ``chosen`` keeps: it maps the keyed rows to a small, stored table with a column rid."""
    scratch = Scratch(docs.sparkSession, name)  # holds rows only where their ids don't serve as keys; the result reads them
    rows = keyed(docs, scratch, whole=True)
    kept = chosen(rows.select("rid", "doc_id", "text")).select("rid")
    return rows.select("rid", "whole").join(kept.hint("merge"), "rid", "left_semi").select("whole.*")


# ---------------------------------------------------------------- Arrow batches


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut evenly so that ``column`` holds about ``limit`` bytes a piece at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        even = -(-int(size[-1]) // max(1, -(-int(size[-1]) // limit)))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + even, side="right")))
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n+1 offsets of its rows in them."""
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


# ---------------------------------------------------------------- word hashes

_rng = np.random.default_rng(20240531)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        n = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, base in enumerate((BASE, inverse)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hashes of any ranges of a uint64 sequence, each in constant time."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _powers_to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * BASE)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a string column.

    start, end: each word's place in the column's bytes; at: the n+1 offsets of the
    documents in the words; hash: a 64-bit hash of each word's bytes."""

    def __init__(self, column: pa.Array, lower: bool = False, hashes: bool = True):
        raw, offsets = text_bytes(column)
        self.raw, self.offsets = raw, offsets
        black = np.zeros(len(raw) + 2, bool)
        black[1:-1] = ~SPACE[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True
        inside = black[1:-1]
        self.start = np.flatnonzero(inside & (~black[:-2] | first[:-1]))
        self.end = np.flatnonzero(inside & (~black[2:] | first[1:])) + 1
        self.at = np.searchsorted(self.start, offsets)
        if hashes:
            self.hash = RangeHash((BYTE_LOWER if lower else BYTE)[raw]).of(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def document(self) -> np.ndarray:
        """Each word's row in the column."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


# ---------------------------------------------------------------- labelled samples


def remainder(doc_id, m: int):
    """crc32 of the id as text, modulo m (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], per_class: int, max_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of the labelled rows whose id's crc32 mod m is not r, for fold (m, r).

    At most ``per_class`` rows of each label, those first by a hash of the id, and of these, in
    the same order, as many as hold ``max_bytes`` of text: a row that doesn't fit is passed over
    alone, and those of more than a sixteenth of ``max_bytes`` are taken after all others.  Only
    whole texts are taken.  If no row of a label that has some fits, that is raised.  Null ids and
    null labels are left out; an id with several labels counts with the smallest."""
    m, r = fold
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), m) != r))
    ids = ids.groupBy("doc_id").agg(F.min(label).cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    chosen = [ids.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class rows
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(picked, "doc_id")
    rows = rows.withColumn("size", F.octet_length("text"))
    order = [F.col("h"), F.col("doc_id"), F.xxhash64("text")]
    rows = rows.orderBy(*order).limit(2 * per_class)  # repeated ids may give more
    # The driver chooses by size; only the chosen texts come to it.
    found = rows.select("h", "doc_id", order[2].alias("text_hash"), "y", "size").orderBy("h", "doc_id", "text_hash").collect()
    chosen, free = [], max_bytes
    for k in sorted(range(len(found)), key=lambda k: (found[k]["size"] > max_bytes // 16, k)):
        if found[k]["size"] <= free:
            chosen.append(k)
            free -= found[k]["size"]
    if lost := {x["y"] for x in found} - {found[k]["y"] for k in chosen}:
        raise ValueError(f"no text with {label} {sorted(lost)} fits in a sample of {max_bytes} bytes")
    keys = sorted({(found[k]["doc_id"], found[k]["text_hash"]) for k in chosen})
    wanted = F.broadcast(docs.sparkSession.createDataFrame(keys, "doc_id long, text_hash long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    text = {(x["doc_id"], x["text_hash"]): x["text"] for x in texts.collect()}
    return [(text[found[k]["doc_id"], found[k]["text_hash"]], found[k]["y"]) for k in sorted(chosen)]


def scored(docs: DataFrame, fold: tuple[int, int], score, **kept) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; ``score`` maps a batch's text column to an array of scores."""
    m, r = fold

    def run(batches):
        for batch in slices(batches, "text"):
            s = np.asarray(score(batch.column("text")), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id"), m) == r, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept_rows(docs: DataFrame, keep, column: str = "text") -> DataFrame:
    """The rows whose text ``keep`` accepts (it maps a text column to an array of booleans), all columns unchanged."""

    def run(batches):
        for batch in slices(batches, column):
            yield batch.filter(pa.array(np.asarray(keep(batch.column(column)), bool)))

    return docs.mapInArrow(run, docs.schema)
