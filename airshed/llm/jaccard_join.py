"""N-gram Jaccard join: rare-first prefix filtering, and the components of its links.

A document's set holds its distinct shingles of ``SIZE`` words (A-Z in lower case); two
documents link when 100 * intersection >= ``PERCENT`` * union.

Order.  Shingles are ordered rare first: by estimated frequency, then hash.  Frequencies are
summed over tasks, from those stretches of documents that saw a shingle in several classes;
the ``FREQUENT`` most frequent ones are broadcast, all others count as rare.  An estimate
moves a shingle in the order, which any order's prefixes allow, and loses no pair.

Prefixes.  With the threshold, linked sets share a shingle within their first
n - ceil(PERCENT * n / 100) + 1; those are joined.  Length and positional filters drop pairs
that can't reach the needed overlap, the suffix filter those whose sets fall unevenly into
ranges of hashes (compared by a count for each range, so without moving the sets); the rest
are verified by the whole sets, once for each pair.

Hot groups.  Equal sets form a class, which joins as one row.  Shingles of up to ``HOT`` classes
give their pairs by a join.  The classes of a larger one meet in blocks of ``LIST``, with the
counts of their ranges; all filters hold there, and only pairs that connect something leave the
task.  What those connect are families: near copies of each other, not all that share a passage.
They are compared in blocks of ``GROUP`` by ``GROUP`` classes, where an index of the block's
shingles finds the links and only those that connect something leave the task: first all of a
family meet one block of it, which connects a family of near copies, then, in families of
several blocks, those outside its largest component meet all of it.  Frequent shingles are dealt
over salts where postings meet.  So every link between different components is found, and links
inside one aren't needed for the components.

Cases: a text of fewer than SIZE words is one shingle; without words (null, empty, blank) the
set is empty and links with nothing.  Repeated rows and rows with repeated or null doc_ids
are rows of their own; component_id is the least doc_id, null only where all are.  Extra
columns are ignored by ``link`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airshed.llm.common import RangeHash, Scratch, Words, keep_rows, keyed, mix, read, slices
from airshed.llm.components import components

SIZE, PERCENT = 5, 80
FREQUENT, LEAST_FREQUENT = 200_000, 16
#: Shingles that a task counts at once.
STRETCH = 2_000_000
#: Classes of one frequent shingle, pairs of one class, or classes of a family's block that meet in a group.
GROUP = 500
#: Classes of a shingle up to which a join gives their pairs.
HOT = 48
#: Classes of a larger one that meet in a group, and those of them that are compared with the rest at a time.
LIST, ROWS = 1000, 64
#: Counts of ranges compared at once.
COUNTS = 1 << 21

FOUND = "kind byte, rid long, doc_id long, n long, key long, ranges binary"
POSTING = "shingle long, salt int, cls long, n int, place int"


def sets(column: pa.Array) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, sorted."""
    words = Words(column, lower=True)
    hashes = RangeHash(words.hash)
    start, end = words.at[:-1], words.at[1:]
    i = np.arange(max(0, len(words) - SIZE + 1))
    all_of = hashes.of(i, i + SIZE)
    short = hashes.of(start, end)
    return [np.unique(all_of[a : b - SIZE + 1]) if b - a >= SIZE else short[k : k + 1] if b > a else short[:0] for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True))]


def class_of(s: np.ndarray) -> int:
    """A hash of a set and its size."""
    return int(mix(np.array([mix(s ^ np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))


def needed(n: int) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return -(-PERCENT * n // 100)


def overlap_needed(n, m):
    """Least intersection of linked sets of n and m: 100 * o >= PERCENT * (n + m - o)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def ranges(s: np.ndarray) -> bytes | None:
    """How many values of a set fall into each of equal ranges of hashes, two to four on average; the number of ranges
    is a power of 2.  None (nothing is known) if a range has more than a byte can count."""
    bits = max(3, (len(s) // 4).bit_length())
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def may_link(n: int, x: bytes | None, m: int, y: bytes | None) -> bool:
    """Whether sets of n and m with these counts by range can overlap enough: values that differ are at least the counts' differences."""
    if x is None or y is None:
        return True
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(axis=1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).sum(axis=1)
    return int(np.abs(x - y).sum()) <= n + m - 2 * overlap_needed(n, m)


def _classes(batches):
    """Documents with their class (kind 0), and shingles of several classes of a stretch with their number (kind 1)."""

    def counted():
        shingle, count = np.unique(np.concatenate(distinct), return_counts=True)
        shingle, count = shingle[count > 1], count[count > 1]
        none = pa.nulls(len(shingle), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(shingle), np.int8)), none, none, pa.array(count.astype(np.int64)), pa.array(shingle.view(np.int64)), pa.nulls(len(shingle), pa.binary())], names=["kind", "rid", "doc_id", "n", "key", "ranges"])

    seen, distinct, total = set(), [], 0
    for batch in slices(batches, "text"):
        found = sets(batch.column("text"))
        cls = [class_of(s) if len(s) else 0 for s in found]
        n = np.array([len(s) for s in found], np.int64)
        new = [c not in seen and not seen.add(c) for c in cls]
        # Only one document of a class brings the counts of its ranges.
        counts = [ranges(s) if k else None for s, k in zip(found, new, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(found), np.int8)), batch.column("rid"), batch.column("doc_id"), pa.array(n), pa.array(cls, pa.int64()), pa.array(counts, pa.binary())], names=["kind", "rid", "doc_id", "n", "key", "ranges"])
        distinct += [s for s, k in zip(found, new, strict=True) if k]
        total += int(n.sum())
        if total >= STRETCH:
            yield counted()
            seen, distinct, total = set(), [], 0
    if distinct:
        yield counted()


def _postings(frequent):
    """Prefix shingles of each different class of a slice; frequent: a broadcast (hashes sorted, rank, salts)."""

    def run(batches):
        hashes, rank, salts = frequent.value
        for batch in slices(batches, "text"):
            done, out = set(), []
            for s in sets(batch.column("text")):
                if not len(s) or (cls := class_of(s)) in done:
                    continue
                done.add(cls)
                at = np.minimum(np.searchsorted(hashes, s), max(len(hashes) - 1, 0))
                known = hashes[at] == s if len(hashes) else np.zeros(len(s), bool)
                order = np.argsort(np.where(known, rank[at] + 1 if len(hashes) else 0, 0), kind="stable")  # rare ones stay in order of their hash
                prefix = order[: len(s) - needed(len(s)) + 1]
                salt = np.where(known[prefix], np.uint64(cls & (1 << 62) - 1) % salts[at[prefix]] if len(hashes) else 0, 0) + (known[prefix] & (salts[at[prefix]] > 1) if len(hashes) else 0)
                out.append((s[prefix].view(np.int64), salt.astype(np.int32), np.full(len(prefix), cls), np.full(len(prefix), len(s), np.int32), np.arange(len(prefix), dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["shingle", "salt", "cls", "n", "place"])

    return run


def _possible(n: Column, place: Column, m: Column, other: Column) -> Column:
    """Length and positional filters for sets that share the shingle at these places of their orders."""
    most = F.least(place, other) + 1 + F.least(n - place, m - other) - 1
    return (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT) & (most * (100 + PERCENT) >= (n + m) * PERCENT)


class RangeCounts:
    """The counts by range of several sets, to compare many pairs at once as ``may_link`` does."""

    def __init__(self, n: np.ndarray, counts: list[bytes | None]):
        self.n, self.counts = n, counts
        self.size = np.array([len(x) if x is not None else 0 for x in counts], np.int64)
        self.level: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts over this number of ranges, of the sets with as many or twice as many, and each set's row there."""
        if size not in self.level:
            rows = np.full(len(self.counts), -1, np.int64)
            parts, k = [], 0
            for own in (size, 2 * size):
                held = np.flatnonzero(self.size == own)
                rows[held] = np.arange(k, k + len(held))
                k += len(held)
                if len(held):
                    found = np.frombuffer(b"".join(self.counts[i] for i in held.tolist()), np.uint8)
                    parts.append(found.reshape(len(held), size, -1).sum(axis=2, dtype=np.int16))
            self.level[size] = rows, np.concatenate(parts)
        return self.level[size]

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sets a[k] and b[k] may link, for pairs that pass the length filter."""
        allowed = self.n[a] + self.n[b] - 2 * overlap_needed(self.n[a], self.n[b])
        least = np.minimum(self.size[a], self.size[b])
        out = np.ones(len(a), bool)
        for size in np.unique(least[least > 0]).tolist():
            rows, counts = self.at(size)
            pairs = np.flatnonzero(least == size)
            for k in range(0, len(pairs), max(1, COUNTS // size)):
                some = pairs[k : k + max(1, COUNTS // size)]
                out[some] = np.abs(counts[rows[a[some]]] - counts[rows[b[some]]]).sum(axis=1, dtype=np.int64) <= allowed[some]
        return out


def forest(n: np.ndarray, place: np.ndarray, side: np.ndarray, counts: list[bytes | None]) -> list[tuple[int, int]]:
    """Pairs of sets that connect what pairs connect that pass all filters, of sets that share a shingle at these places of
    their orders.  With two sides, only pairs across them count."""
    order = np.argsort(n, kind="stable")
    n, place, side = (x[order].astype(np.int64) for x in (n, place, side))
    held = RangeCounts(n, [counts[k] for k in order.tolist()])
    two, part, out = side.any(), np.arange(len(n)), []
    for at in range(0, len(n), ROWS):
        end = int(np.searchsorted(n, n[min(at + ROWS, len(n)) - 1] * 100 // PERCENT, "right"))
        x, y = np.arange(at, min(at + ROWS, len(n)))[:, None], np.arange(at, end)[None, :]
        most = np.minimum(place[x], place[y]) + np.minimum(n[x] - place[x], n[y] - place[y])
        near = (x < y) & (part[x] != part[y]) & (n[x] * 100 >= n[y] * PERCENT) & (most * (100 + PERCENT) >= (n[x] + n[y]) * PERCENT)
        a, b = np.nonzero(near & (side[x] != side[y]) if two else near)
        a, b = a + at, b + at
        keep = held.may_link(a, b)
        a, b = a[keep], b[keep]
        for row in np.unique(a).tolist():
            others = b[np.searchsorted(a, row, "left") : np.searchsorted(a, row, "right")]
            parts, first = np.unique(part[others], return_index=True)
            new = parts != part[row]
            if new.any():
                out += [(int(order[row]), int(order[k])) for k in others[first[new]].tolist()]
                part[np.isin(part, parts[new])] = part[row]
    return out


def _connect_likely(batches):
    """Pairs (a, b) of the groups; a group's rows come in order."""
    group, rows = None, []

    def found():
        cls, n, place, side, counts = zip(*rows, strict=True) if rows else ((),) * 5
        pairs = forest(np.array(n, np.int64), np.array(place, np.int64), np.array(side, bool), list(counts))
        return pa.RecordBatch.from_arrays([pa.array([cls[a] for a, _ in pairs], pa.int64()), pa.array([cls[b] for _, b in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        for shingle, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("shingle", "i", "j", "cls", "n", "place", "side", "ranges")), strict=True):
            if (shingle, i, j) != group:
                yield found()
                group, rows = (shingle, i, j), []
            rows.append(row)
    yield found()


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    need = overlap_needed(len(x), len(y))
    if min(len(x), len(y)) < need:
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum()) >= need


def _suffix_filter(batches):
    """The pairs (hub, cls) that the counts by range allow."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("n", "ranges", "m", "others"))
        keep = [may_link(n, x, m, y) for n, x, m, y in zip(*columns, strict=True)]
        yield batch.select(["hub", "cls"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(batches):
    """(cls, shingles) of the documents that stand for their classes."""
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([s.tobytes() for s in sets(batch.column("text"))], pa.binary())], names=["cls", "shingles"])


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (hub, cls) that pass the suffix filter."""
    one = classes.select(F.col("cls").alias("hub"), "n", "ranges")
    two = classes.select("cls", F.col("n").alias("m"), F.col("ranges").alias("others"))
    pairs = pairs.join(one.hint("merge"), "hub").join(two.hint("merge"), "cls").select("hub", "cls", "n", "ranges", "m", "others")
    return pairs.mapInArrow(_suffix_filter, "hub long, cls long")


def _verify(batches):
    """Links (a, b) of each hub with the members of its groups; a group's rows come in order, the hub first."""
    group, own = None, None
    for batch in batches:
        a, b = [], []
        for hub, salt, owner, cls, data in zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "owner", "cls", "shingles")), strict=True):
            s = np.frombuffer(data, np.uint64)
            if owner:
                group, own = (hub, salt), s
            elif group == (hub, salt) and linked(own, s):
                a.append(hub)
                b.append(cls)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verify(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """The pairs (hub, cls) whose sets link, as (a, b).  A hub's pairs are dealt over groups of about GROUP."""
    size = pairs.groupBy("hub").agg((F.ceil(F.count(F.lit(1)) / GROUP)).cast("int").alias("salts"))
    members = pairs.join(size.hint("merge"), "hub").select("cls", "hub", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("owner"))
    owners = size.select(F.col("hub").alias("cls"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("owner"))
    sent = members.unionByName(owners).join(stored.hint("merge"), "cls").select("hub", "salt", "owner", "cls", "shingles")
    sent = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("owner").desc(), "cls")
    return sent.mapInArrow(_verify, "a long, b long")


def sized(met: DataFrame, scratch: Scratch) -> DataFrame:
    """The postings of shingles that several classes share, with their number."""
    met = met.select("shingle", "cls", "n", "place").distinct()
    size = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return scratch.keep(met.join(size.hint("merge"), "shingle"), "sized")


def cold_pairs(held: DataFrame) -> DataFrame:
    """All pairs of classes that share a prefix shingle of up to HOT classes and pass the filters."""
    held = held.where(F.col("size") <= HOT)
    x, y = held.alias("x"), held.alias("y")
    near = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.cls") > F.col("y.cls")) & _possible(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"))
    return x.join(y.hint("merge"), near).select(F.col("x.cls").alias("hub"), F.col("y.cls").alias("cls")).distinct()


def block_links(xs: list[tuple[int, int, np.ndarray]], ys: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between the two sides of a block, of (cls, component, set): those that connect components not connected yet."""
    part: dict[int, int] = {}

    def top(c: int) -> int:
        while part.setdefault(c, c) != c:
            part[c] = part[part[c]]
            c = part[c]
        return c

    out = []
    size = np.array([len(s) for _, _, s in ys])
    shingle = np.concatenate([s for _, _, s in ys])
    owner = np.repeat(np.arange(len(ys)), size)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    for cls, component, s in xs:
        low, high = np.searchsorted(shingle, s, "left"), np.searchsorted(shingle, s, "right")
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        overlap = np.bincount(owner[at], minlength=len(ys))
        for k in np.flatnonzero(100 * overlap >= PERCENT * (len(s) + size - overlap)).tolist():
            if (a := top(component)) != (b := top(ys[k][1])):
                part[a] = b
                out.append((cls, ys[k][0]))
    return out


def _compare_blocks(batches):
    """Links (a, b) of the blocks; a block's rows come in order, its first side first."""
    block, sides = None, ([], [])

    def found():
        links = block_links(*sides) if sides[0] and sides[1] else []
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    for batch in batches:
        for family, i, j, side, cls, component, data in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            if (family, i, j) != block:
                yield found()
                block, sides = (family, i, j), ([], [])
            sides[side].append((cls, component, np.frombuffer(data, np.uint64)))
    yield found()


def families(held: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, family) of the classes that pairs connect which share a shingle of more than HOT classes and pass all filters."""
    hot = held.where(F.col("size") > HOT).join(classes.select("cls", "ranges").hint("merge"), "cls")
    blocks = F.ceil(F.col("size") / LIST).cast("int")
    dealt = hot.withColumn("own", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "cls", "n", "place", "ranges")
    dealt = dealt.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    found = components(dealt.mapInArrow(_connect_likely, "a long, b long"), scratch, "families")
    least = found.select(F.col("component").alias("cls"), F.col("component").alias("family")).distinct()
    return scratch.keep(found.select(F.col("node").alias("cls"), F.col("component").alias("family")).unionByName(least), "members")


def family_links(members: DataFrame, parts: DataFrame, stored: DataFrame, scratch: Scratch, name: str, one_block: bool) -> DataFrame:
    """Links (a, b) between unconnected classes of each family: of all of it with one block, or, in families of several
    blocks, of those outside its largest component with all of it."""
    held = members.join(parts.select(F.col("node").alias("cls"), "component").hint("merge"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    by_part = held.groupBy("family", "component").agg(F.count(F.lit(1)).alias("k"))
    size = by_part.groupBy("family").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.sum("k").alias("all"), (F.sum("k") - F.max("k")).alias("outside"))
    blocks = lambda n: F.ceil(F.col(n) / GROUP).cast("int")
    size = scratch.keep(size.where((F.col("outside") > 0) & (F.lit(one_block) | (F.col("all") > GROUP))).select("family", "largest", blocks("all" if one_block else "outside").alias("xs"), blocks("all").alias("ys")), f"{name}_size")
    own = F.xxhash64("cls")
    dealt = held.join(size.hint("merge"), "family").withColumn("i", F.pmod(own, "xs").cast("int")).withColumn("j", F.pmod(own, "ys").cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if one_block:
        left = dealt.select("family", "i", F.lit(0).alias("j"), F.lit(0).alias("side"), "cls", "component")
        right = dealt.where("j = 0").select("family", every("xs").alias("i"), "j", F.lit(1).alias("side"), "cls", "component")
    else:
        left = dealt.where("component <> largest").select("family", "i", every("ys").alias("j"), F.lit(0).alias("side"), "cls", "component")
        right = dealt.select("family", every("xs").alias("i"), "j", F.lit(1).alias("side"), "cls", "component")
    sent = left.unionByName(right).join(stored.hint("merge"), "cls").select("family", "i", "j", "side", "cls", "component", "shingles")
    sent = sent.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "cls")
    return scratch.keep(sent.mapInArrow(_compare_blocks, "a long, b long"), f"{name}_links")


def _components(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, doc_id, n_shingles, component (a rid), component_id of keyed rows."""
    spark = rows.sparkSession
    found = scratch.keep(rows.mapInArrow(_classes, FOUND), "found")
    documents = found.where("kind = 0").select("rid", "doc_id", "n", F.col("key").alias("cls"))
    often = found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= LEAST_FREQUENT)
    often = often.orderBy(F.desc("f"), "key").limit(FREQUENT).toArrow()
    key, f = often["key"].to_numpy(), often["f"].to_numpy()
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort((key, f))] = np.arange(len(key))
    hashes = key.view(np.uint64)
    by_hash = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast((hashes[by_hash], rank[by_hash], (f[by_hash] // GROUP + 1).astype(np.uint64)))
    classes = found.where("kind = 0 AND n > 0").groupBy(F.col("key").alias("cls")).agg(
        F.min("rid").alias("rid"), F.min_by("doc_id", "rid").alias("doc_id"), F.first("n").alias("n"), F.first("ranges", ignorenulls=True).alias("ranges")
    )
    classes = scratch.keep(classes, "classes")

    # Classes met by shared prefix shingles; those that meet no other class are dropped.
    meet = Window.partitionBy("shingle", "salt")
    met = rows.select("text").mapInArrow(_postings(frequent), POSTING)
    met = met.withColumn("least", F.min("cls").over(meet)).withColumn("last", F.max("cls").over(meet))
    met = scratch.keep(met.where((F.col("least") != F.col("last")) | (F.col("salt") > 0)).drop("least", "last"), "met")
    held = sized(met, scratch)
    pairs = scratch.keep(likely(cold_pairs(held), classes), "pairs")
    members = families(held, classes, scratch)
    # The sets of all classes that are to be compared, fetched once.
    asked = pairs.select("cls").unionByName(pairs.select(F.col("hub").alias("cls"))).unionByName(members.select("cls")).distinct()
    asked = scratch.keep(asked.join(classes.select("cls", "rid").hint("merge"), "cls"), "asked")
    stored = scratch.keep(rows.select("rid", "text").join(asked, "rid").select("cls", "text").mapInArrow(_sets_of, "cls long, shingles binary"), "sets")

    as_links = lambda parts: parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts = components(verify(pairs, stored), scratch, "cold")
    for name, one_block in (("block", True), ("rest", False)):
        links = family_links(members, parts, stored, scratch, name, one_block)
        if not links.isEmpty():
            parts = components(as_links(parts).unionByName(links), scratch, f"{name}_parts")

    placed = classes.join(parts.select(F.col("node").alias("cls"), F.col("component").alias("part")).hint("merge"), "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    least = scratch.keep(placed.groupBy("part").agg(F.min("rid").alias("component"), F.min_by("doc_id", "rid").alias("component_id")), "least")
    placed = scratch.keep(placed.select("cls", "part").join(least.hint("merge"), "part").select("cls", "component", "component_id"), "placed")
    none = F.col("n") == 0
    out = documents.join(placed.hint("merge"), "cls", "left").select(
        "rid", "doc_id", F.col("n").alias("n_shingles"), F.when(none, F.col("rid")).otherwise(F.col("component")).alias("component"), F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return scratch.finish(out)


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    return _components(keyed(docs, scratch), scratch).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document (by doc_id) of every component, with all columns."""
    return keep_rows(docs, "jaccard-rows", lambda rows: _components(rows, Scratch(docs.sparkSession, "jaccard")).where("rid = component"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n_words
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents) t
), runs AS (
  SELECT doc_id, pos, n_words, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS shingle FROM w
), s AS (
  SELECT DISTINCT doc_id, shingle FROM runs WHERE pos <= greatest(n_words - 4, 1)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reached AS (
  SELECT doc_id, doc_id AS start FROM documents
  UNION SELECT b, start FROM reached JOIN links ON a = reached.doc_id
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(start) AS component_id FROM reached LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
