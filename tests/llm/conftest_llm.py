"""Brute-force versions shared by the tests."""

import collections
import re



LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:  # names that the operators use inside
        for c in ("rid", "digest", "kept", "cls", "hub", "runs", "batch", "score", "y", "h"):
            df = df.withColumn(c, df["lang"])
    return df


def shingle_sets(rows):
    out = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def components_by_brute_force(rows):
    """doc_id -> (set size, least doc_id reachable by links)."""
    sets = shingle_sets(rows)
    ids = [r[0] for r in rows]
    part = list(range(len(ids)))

    def top(k):
        while part[k] != k:
            k = part[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * len(sets[a] | sets[b]):
                part[top(a)] = top(b)
    least = collections.defaultdict(list)
    for k in range(len(ids)):
        least[top(k)].append(ids[k])
    return {ids[k]: (len(sets[k]), min(least[top(k)])) for k in range(len(ids))}
