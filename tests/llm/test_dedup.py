"""Exact, substring and Jaccard deduplication against brute force."""

import hashlib
import re

import pytest
from conftest_llm import components_by_brute_force, frame, shingle_sets

from airshed.llm import exact_dedup, jaccard_join, substring_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_decisions(spark, documents):
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.decisions(frame(spark, documents, extra=True)).collect()}
    groups = {}
    for d, t, *_ in documents:
        groups.setdefault(normal(t), []).append(d)
    assert got == {d: (min(g := groups[normal(t)]), len(g), d == min(g), hashlib.sha256(normal(t).encode()).hexdigest()) for d, t, *_ in documents}


def test_exact_odd_ids_keep_one_row_a_text(spark, odd):
    rows = exact_dedup.decisions(frame(spark, odd)).collect()
    assert len(rows) == len(odd)
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert len(kept) == len(set(kept)) == len({normal(t) for _, t, *_ in odd})
    assert {r["keep_id"] for r in rows if r["doc_id"] == 3} == {3}


def test_exact_index_over_batches(spark, documents):
    index = exact_dedup.DigestIndex(spark, "digest_index_test", 4)
    try:
        first = exact_dedup.decisions(frame(spark, documents[:30]), index, "b1").collect()
        again = exact_dedup.decisions(frame(spark, [(1000 + d, *r) for d, *r in documents[:30]]), index, "b2").collect()
        assert sum(r["kept"] for r in again) == 0
        assert {r["keep_id"] for r in again} == {r["keep_id"] for r in first}
        rows = index.rows().collect()
        assert len(rows) == len({bytes(r["digest"]) for r in rows}) == len({normal(t) for _, t, *_ in documents[:30]})
        plan = index.rows().select("digest").join(spark.range(1).selectExpr("unhex('00') AS digest").hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 1  # the index itself isn't shuffled
    finally:
        index.drop()


def test_exact_index_is_found_again_and_compacted(spark, documents, tmp_path, monkeypatch):
    place = str(tmp_path / "it's an index")
    monkeypatch.setattr(exact_dedup, "MAX_FILES", 3)
    index = exact_dedup.DigestIndex(spark, "digest_index_kept", 4, place)
    for k in range(6):
        exact_dedup.decisions(frame(spark, documents[: 12 * k + 12]), index, f"b{k}").count()
    assert index.generation > 0  # it was compacted on the way
    rows = sorted(map(tuple, index.rows().collect()), key=str)
    assert len(rows) == len({normal(t) for _, t, *_ in documents[:72]})
    index.compact()
    assert sorted(map(tuple, index.rows().collect()), key=str) == rows
    assert len([x for x in index._names(index._folder(index.generation)) if x.startswith("part-")]) <= 4  # a file for each bucket
    spark.sql("DROP TABLE digest_index_kept")  # as after the session's end
    (tmp_path / "it's an index" / f"g{index.generation + 1}-b9").mkdir()  # a compaction that failed
    later = exact_dedup.DigestIndex(spark, "digest_index_kept", 9, place)
    assert later.buckets == 4 and sorted(map(tuple, later.rows().collect()), key=str) == rows
    again = exact_dedup.decisions(frame(spark, documents[:72]), later, "later").collect()
    assert not any(r["kept"] for r in again)
    plan = later.rows().select("digest").join(spark.range(1).selectExpr("unhex('00') AS digest").hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1
    # a batch that is given again gets the same answer
    fresh = documents[72:90]
    one, two = (sorted(exact_dedup.decisions(frame(spark, fresh), later, "twice").collect(), key=lambda r: r["doc_id"]) for _ in range(2))
    assert one == two and any(r["kept"] for r in one)
    later.drop()
    assert not (tmp_path / "it's an index").exists()


def test_exact_index_leaves_other_tables_alone(spark, tmp_path):
    spark.range(3).write.mode("overwrite").saveAsTable("digest_index_other")
    try:
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, "digest_index_other", 2, str(tmp_path / "x"))
        assert spark.table("digest_index_other").count() == 3
    finally:
        spark.sql("DROP TABLE digest_index_other")


def test_exact_keep_first(spark, odd, documents):
    df = frame(spark, documents, extra=True)
    out = exact_dedup.keep_first(df)
    assert out.columns == df.columns
    kept = sorted(r["doc_id"] for r in out.collect())
    seen, want = set(), []
    for d, t, *_ in sorted(documents, key=lambda r: r[0]):
        if normal(t) not in seen:
            seen.add(normal(t))
            want.append(d)
    assert kept == want
    assert exact_dedup.keep_first(frame(spark, odd)).count() == len({normal(t) for _, t, *_ in odd})


def repeats_by_brute_force(rows):
    """doc_id, n_words, n_removed, digest of rows in their order."""
    seen, out = set(), []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring(spark, documents):
    got = substring_dedup.remove_repeats(frame(spark, documents, extra=True)).collect()
    want = repeats_by_brute_force(sorted(documents, key=lambda r: r[0]))
    assert sorted(tuple(r)[:4] for r in got) == want
    assert sum(w[2] for w in want) > 1000
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(s["end"] - s["start"] >= 20 for s in r["spans"])


def test_substring_many_slices_and_partitions(spark, documents, monkeypatch):
    got = substring_dedup.remove_repeats(frame(spark, documents).repartition(13)).collect()
    assert sorted(tuple(r)[:4] for r in got) == repeats_by_brute_force(sorted(documents, key=lambda r: r[0]))


def test_substring_odd_ids(spark, odd):
    got = substring_dedup.remove_repeats(frame(spark, odd)).collect()
    assert len(got) == len(odd)
    from pyspark.sql import functions as F

    order = frame(spark, odd).withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    order.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(repeats_by_brute_force([(r["doc_id"], r["text"]) for r in order]), key=key)


def test_leftmost_least():
    import numpy as np

    rng = np.random.default_rng(0)
    for size in (1, 2, 3, 5, 15):
        x = rng.integers(0, 4, 60).astype(np.uint64)
        got = substring_dedup.leftmost_least(x, size)
        assert got.tolist() == [i + int(np.argmin(x[i : i + size])) for i in range(len(x) - size + 1)]


def test_jaccard(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(frame(spark, documents, extra=True)).collect()}
    assert got == components_by_brute_force(documents)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_near_the_threshold(spark, seed):
    """Families of texts at all distances, chains of links, one large family."""
    import random

    rng = random.Random(seed)
    rows = []
    for family in range(6):
        text = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(20, 80))]
        for _ in range(60 if family == 0 else 8):
            rows.append((len(rows), " ".join(text), "en", "s", 0))
            source = text if family == 0 else text[:]
            other = source[:]
            for _ in range(rng.randint(1, 3)):
                other[rng.randrange(len(other))] = f"w{rng.randrange(4000)}"
            text = other if rng.random() < (0.3 if family == 0 else 0.9) else text
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(frame(spark, rows)).collect()}
    assert got == components_by_brute_force(rows)


def test_jaccard_frequent_shingles_are_salted(spark, monkeypatch):
    """Many near copies of one text, with groups so small that hubs, salts and the second round all work."""
    import random

    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "HOT", 6)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        text = base[:]
        for _ in range(rng.choice([1, 1, 2, 3])):
            text[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(text), "en", "s", 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(frame(spark, rows)).collect()}
    assert got == components_by_brute_force(rows)


def test_jaccard_shared_passages_make_no_families(spark, monkeypatch):
    """Texts that only share a passage are no family, however many they are, and their sets stay where they are; near copies are one."""
    import random

    from airshed.llm.common import Scratch

    monkeypatch.setattr(jaccard_join, "HOT", 6)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)  # the passages' shingles are in the prefixes
    monkeypatch.setattr(jaccard_join, "LIST", 7)  # groups of several blocks
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(30)] for _ in range(3)]
    rows = []
    for k in range(60):  # two passages each, so that all three meet
        text = [word() for _ in range(40)] + passages[k % 3] + [word() for _ in range(20)] + passages[(k + 1) % 3]
        rows.append((len(rows), " ".join(text), "en", "s", 0))
    base = [word() for _ in range(120)]
    for _ in range(30):
        text = base[:]
        text[rng.randrange(120)] = word()
        rows.append((len(rows), " ".join(text), "en", "s", 0))
    stored, keep = {}, Scratch.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        stored[name] = sorted(r[0] for r in out.select(out.columns[0]).collect())
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(frame(spark, rows)).collect()}
    assert got == components_by_brute_force(rows)
    assert len(stored["members"]) == 30 and stored["members"] == stored["sets"]


def test_forest_connects_what_may_link():
    import numpy as np

    rng = np.random.default_rng(6)
    for trial in range(24):
        k = int(rng.integers(2, 150))
        base = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 400), dtype=np.uint64) * np.uint64(2)) for _ in range(4)]
        sets = []
        for _ in range(k):
            b = base[rng.integers(4)]
            kept = b[rng.random(len(b)) > rng.choice([0, 0.02, 0.05, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, rng.integers(1, 6), dtype=np.uint64)])))
        n, place = np.array([len(s) for s in sets]), np.array([rng.integers(0, max(1, len(s) // 5)) for s in sets])
        counts = [jaccard_join.ranges(s) if rng.random() > 0.03 else None for s in sets]
        side = rng.random(k) > 0.5 if trial % 2 else np.zeros(k, bool)
        found = jaccard_join.forest(n, place, side, counts)
        part = list(range(k))
        top = lambda a: a if part[a] == a else top(part[a])
        for a, b in found:
            assert top(a) != top(b)
            part[top(a)] = top(b)
        may = 0
        for a in range(k):
            for b in range(a):
                if side.any() and side[a] == side[b]:
                    continue
                most = min(place[a], place[b]) + min(n[a] - place[a], n[b] - place[b])
                if 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b]) and most * 180 >= 80 * (n[a] + n[b]) and jaccard_join.may_link(int(n[a]), counts[a], int(n[b]), counts[b]):
                    may += 1
                    assert top(a) == top(b)
        assert len(found) <= may


def test_jaccard_keep_one_and_odd_ids(spark, documents, odd):
    df = frame(spark, documents, extra=True)
    out = jaccard_join.keep_one(df)
    assert out.columns == df.columns
    parts = components_by_brute_force(documents)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({p for _, p in parts.values()})
    rows = jaccard_join.link(frame(spark, odd)).collect()
    assert len(rows) == len(odd)
    assert jaccard_join.keep_one(frame(spark, odd)).count() <= len(odd)


def test_suffix_filter_loses_no_link():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        pool = rng.integers(0, 1 << 63, n + 60, dtype=np.uint64) * np.uint64(2)
        x = np.unique(pool[:n])
        y = np.unique(np.concatenate([x[: len(x) - len(x) // 9], pool[n : n + len(x) // 12]]))
        if jaccard_join.linked(x, y):
            assert jaccard_join.may_link(len(x), jaccard_join.ranges(x), len(y), jaccard_join.ranges(y))
    same = np.arange(4000, dtype=np.uint64)  # all in one range
    assert jaccard_join.ranges(same) is None and jaccard_join.may_link(4000, None, 4000, b"")


def test_block_links_connect_what_links():
    import random

    import numpy as np

    rng = random.Random(3)
    sets = []
    for k in range(60):
        base = np.arange(k % 3 * 1000, k % 3 * 1000 + 60, dtype=np.uint64)
        base[rng.sample(range(60), rng.randint(0, 9))] = [rng.randrange(10**6, 10**7) for _ in range(1)][0] + k
        sets.append((k, k, np.unique(base)))
    links = jaccard_join.block_links(sets, sets)
    part = list(range(60))
    top = lambda k: k if part[k] == k else top(part[k])
    for a, b in links:
        assert jaccard_join.linked(sets[a][2], sets[b][2])
        part[top(a)] = top(b)
    assert len(links) < 60
    for a in range(60):
        for b in range(a):
            if jaccard_join.linked(sets[a][2], sets[b][2]):
                assert top(a) == top(b)


def test_linked_is_the_jaccard_threshold():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(400):
        n = rng.integers(1, 60)
        pool = np.arange(int(n * 1.3) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x, y = (np.sort(rng.choice(pool, rng.integers(max(1, n // 2), n + 1), replace=False)) for _ in range(2))
        o = len(np.intersect1d(x, y))
        assert jaccard_join.linked(x, y) == (100 * o >= 80 * (len(x) + len(y) - o))


@pytest.mark.parametrize("run", [exact_dedup.decisions, exact_dedup.keep_first, substring_dedup.remove_repeats, jaccard_join.link, jaccard_join.keep_one])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_sets_of_short_texts():
    assert [len(s) for s in shingle_sets([(0, None), (1, " "), (2, "a"), (3, "a b c d"), (4, "a b c d e"), (5, "a a a a a a")])] == [0, 0, 1, 1, 1, 1]
