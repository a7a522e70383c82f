"""Chat formatting, spelling variants and token alignment against plain versions."""

import collections
import json
import random
import re
import zlib

import duckdb
import pytest
from brute_align import alignments as brute_alignments
from conftest_llm import frame
from pyspark.sql import functions as F

from airshed.llm import chat_format as C
from airshed.llm import spelling as S
from airshed.llm import token_align as T

# ---------------------------------------------------------------- chat formatting

PIECES = ["\\", "#", "##", "###", "### User: ", "### Assistant: ", "</turn>", "</turn>\n", "<", "/turn>", "\n", ": ", "~", "é😀", "word ", "$1", "\\/", "\\#", ""]
ROWS = "conv_id long, turn long, role string, text string"


def odd_turns():
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "User", "a: b", "~x\\", "### ", "", "</turn>"])
            rows.append((conv, turn, role, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))))
    rows += [(1000, 0, "user", None), (1000, 1, "assistant", None), (1001, None, "assistant", "x"), (1001, 0, "user", "y"), (None, 0, "user", "null id"), (None, 0, "user", "null id"), (1002, 5, "assistant", "long " * 60_000)]
    return rows + rows[:7]


def test_chat_round_trip(spark):
    made = C.conversations(spark.createDataFrame(odd_turns(), ROWS))
    written = C.template(made)
    want = {r["conv_id"]: r["turns"] for r in made.collect()}
    back = C.read_back(written).collect()
    assert len(back) == len(want)
    for r in back:
        assert r["turns"] == want[r["conv_id"]]
        assert r["loss_text"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        pieces = r["formatted"].split("</turn>\n")
        assert len(pieces) == len(r["turns"]) + 1 and pieces[-1] == ""  # no control string but the template's own
        assert all(p.startswith("### ") and "##" not in p[4:].replace("\\#", "") for p in pieces[:-1])


def test_chat_query_and_sql(spark, tmp_path):
    rows = spark.createDataFrame(odd_turns(), ROWS).withColumns({"turns": F.lit("x"), "formatted": F.lit(1), "loss_mask": F.lit(2.0), "t": F.lit(None).cast("string")})
    for name, df in (("some", rows), ("none", rows.limit(0))):
        path = str(tmp_path / name)
        df.write.parquet(f"{path}/conversations.parquet")
        got = sorted(map(tuple, C.op12_chat_format(spark, path).collect()), key=str)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS FROM '{path}/conversations.parquet/*.parquet'")
        assert got == sorted(con.sql(C.SQL).fetchall(), key=str)
        assert len(got) == (65 if name == "some" else 1)


def test_chat_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", turns),
        ({"id": 7, "messages": [{"content": None, "role": "user"}]}, "messages", [("user", "")]),
        ({"messages": []}, "messages", []),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"}, "conversations", [("system", "s"), *turns]),
        ({"data": {"dialog": [{"speaker": "human", "utterance": "q"}, {"speaker": "bot", "utterance": "a"}], "id": "x"}}, "dialog", turns),
        ({"instruction": "q", "input": "more", "output": "a"}, "instruction", [("user", "q\n\nmore"), ("assistant", "a")]),
        ({"output": "a", "instruction": "q"}, "instruction", turns),
        ({"instruction": "q", "input": "", "output": None}, "instruction", [("user", "q"), ("assistant", "")]),
        ({"prompt": "q", "response": "a", "system": None}, "prompt_response", turns),
        ({"prompt": "q", "completion": "a"}, "prompt_completion", turns),
        ({"question": "q", "answer": 12}, "question_answer", [("user", "q"), ("assistant", "12")]),
        ({"prompt": "q", "chosen": "a", "rejected": "b"}, "preference", turns),
        ({"messages": ["q", "a"]}, None, []),
        ({"messages": {"role": "user", "content": "q"}}, None, []),
        ({"prompt": "q", "answer": "a"}, None, []),
        ({"messages: STRING, x": "q"}, None, []),
        ({}, None, []),
    ]
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(records)] + [(100, "{broken"), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "n long, record string").withColumns({"layout": F.lit(5), "turns": F.lit("clash")})
    got = {r["n"]: r for r in C.canonical(df).collect()}
    for k, (_, layout, want) in enumerate(records):
        assert (got[k]["layout"], [tuple(t) for t in got[k]["turns"]]) == (layout, want), k
    assert all(got[n]["layout"] is None and got[n]["turns"] == [] for n in (100, 101, 102))
    assert C.canonical(df.limit(0)).collect() == []
    counts = {(r["layout"], r["paths"]): r["records"] for r in C.layouts(df).collect()}
    assert counts["instruction", "OBJECT<input: , instruction: , output: >"] == 2
    assert len({r["fingerprint"] for r in got.values() if r["layout"] == "instruction"}) == 2  # with input and without


def test_chat_other_row_layout(spark):
    rows = spark.createDataFrame([(1, 1, "bot", "b"), (1, 0, "human", "a")], "conversation_id long, index long, speaker string, utterance string")
    assert [[tuple(t) for t in r["turns"]] for r in C.conversations(rows).collect()] == [[("human", "a"), ("bot", "b")]]
    with pytest.raises(ValueError):
        C.conversations(rows.drop("speaker"))


# ---------------------------------------------------------------- spelling variants


def brute_variants(rows):
    n = collections.Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(S.UPPER, S.LOWER))
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    open_at = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            open_at[len(w), i, w[:i] + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for group in open_at.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        for i in range(len(w)):
            if (x := w[:i] + w[i + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def spelled():
    rng = random.Random(8)
    hot = ["statementxy" + "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(300)]  # one chunk in a third of all words
    other = ["".join(rng.choice("abcé÷") for _ in range(rng.randint(6, 9))) for _ in range(500)]
    chain = ["governments"] * 1300 + ["governmens"] * 130 + ["governmens" + "s"] * 3 + ["governmes"] * 12 + ["aaaaaaa", "aaaaaaaa"] * 30 + ["aaaaaaaaa"] * 2
    rows = []
    for k in range(400):
        rows.append((k, " ".join(rng.choice(hot + other + chain) + rng.choice([" ", "-", "7", ". "]) for _ in range(60)).upper() if k % 3 == 0 else " ".join(rng.choices(hot + other, k=60) + rng.choices(chain, k=40)), "en", "s", 1))
    return [*rows, (None, "governments Governments Γovernments", None, None, None), (5, None, "en", "s", 0), (6, "", "en", "s", 0), rows[0], (9, "governments" * 3000 + " governments", "en", "s", 0)]


@pytest.mark.parametrize("hot", [2, S.HOT])
def test_spelling_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S.near_pairs, "__defaults__", (hot,))
    rows = spelled()
    want = brute_variants(rows)
    assert sum(x[1] is not None for x in want) > 5 and any(x[2] not in (x[0], x[1]) for x in want) and max(x[4] for x in want) > 9
    assert sorted(map(tuple, S.variants(frame(spark, rows, extra=True).withColumns({"word": F.lit(1), "n": F.lit("x"), "id": F.lit(0)})).collect())) == want


def test_spelling_without_words(spark):
    assert S.variants(frame(spark, [])).collect() == []
    assert S.variants(frame(spark, [(1, "short words only", None, None, None), (2, None, None, None, None)])).collect() == []


# ---------------------------------------------------------------- token alignment


def aligned_rows(documents):
    odd = ["<|endoftext|> inside", "</s><s><unk>", "▁mark", "a▁b", " lead", "trail ", "  two  spaces  ", "tab\tnew\nline", "é😀 ümlaut ÇA", "\x00nul", "don't we'll 'sabc def", "x" * 300, "　wide​zero", "漢字かな", "1234567 89", "a b c d", "\n\n\n", " ", "A", "aa aa aa"]
    long = [" ".join(["the river and Étoile it's 12,5"] * 20_000), " " * 25_000 + "x"]
    rows = [(1000 + k, t) for k, t in enumerate(odd + long)] + [(d, t) for d, t, *_ in documents[:60]]
    return [*rows, (None, "null id"), (None, None), (3, ""), rows[0], rows[1]]


def test_alignment_against_plain_version(spark, documents):
    import public_tokenizers as P

    rows = aligned_rows(documents)
    want = sorted(brute_alignments(rows), key=str)
    assert sum(x[1] == 0 for x in want) >= 3 and all(x[1] + x[2] - x[3] == x[4] for x in want)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit("x"), "n_a": F.lit(1), "pair": F.lit(2)})
    for chunk, parts in ((1 << 12, 3), (T.CHUNK_BYTES, 1)):
        got = sorted(map(tuple, T.alignments(df.repartition(parts), P.path(T.A), P.path(T.B), chunk).collect()), key=str)
        assert got == want
    assert T.alignments(df.limit(0), P.path(T.A), P.path(T.B)).collect() == []


def test_best_map(spark):
    import public_tokenizers as P

    texts = ["the river", "the river Fluß", "rivers and stones", "the the"]
    best = {}
    for r in T.best_map(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path(T.A), P.path(T.B)).collect():
        best.setdefault(r["a"], set()).add((r["b"], r["n"]))
    model = T.aligner(P.path(T.A), P.path(T.B))
    count = collections.Counter()
    for t in texts:
        a, _, b, _ = model._encode([t])
        x = model.align(__import__("pyarrow").array([t]))
        count.update(x["pair"].tolist())
        assert len(a) == x["n_a"][0] and len(b) == x["n_b"][0]
    size = len(model.b.size)
    for a in {p // size for p in count}:
        most = max(n for p, n in count.items() if p // size == a)
        assert best[a] == {(p % size, n) for p, n in count.items() if p // size == a and n == most}


def test_cache_keeps_results(monkeypatch, documents):
    import public_tokenizers as P
    import pyarrow as pa

    texts = [t for _, t, *_ in documents[:80]]
    whole = T.Aligner(P.path(T.A), P.path(T.B))
    want = [whole.align(pa.array([t], pa.string())) for t in texts]
    monkeypatch.setattr(T, "CACHE_UNITS", 40)
    small = T.Aligner(P.path(T.A), P.path(T.B))
    for t, w in zip(texts, want, strict=True):
        got = small.align(pa.array([t], pa.string()))
        assert all(list(got[k]) == list(w[k]) for k in w)


# ---------------------------------------------------------------- seating of the language model


def test_small_tables_follow_their_exact_weights():
    import numpy as np

    from airshed.llm import pitman_yor as P

    d, c, k = 0.6, 40, 4000
    table = P.log_seatings(d)[c, 1 : c + 1]
    p = table + np.arange(c) * np.log(1.3)
    p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
    found = np.bincount(P.small_tables(np.full(k, c), np.full(k, 1.3), d, (np.arange(k) + 0.5) / k), minlength=c + 1)[1:] / k
    assert np.abs(np.cumsum(found) - np.cumsum(p)).max() < 1.01 / k  # evenly spaced numbers give the weights themselves
    mixed = np.array([2, 5, 1000, 2, 77])
    u = np.array([0.1, 0.9, 0.5, 0.1, 0.3])
    one_by_one = [P.small_tables(mixed[i : i + 1], np.full(1, 2.0), d, u[i : i + 1])[0] for i in range(5)]
    assert P.small_tables(mixed, np.full(5, 2.0), d, u).tolist() == one_by_one


def test_scores_do_not_depend_on_the_layout(spark, documents):
    from airshed.llm import pitman_yor as P

    docs = frame(spark, documents)
    a, b = ({r["doc_id"]: r["score"] for r in P.score_documents(x).collect()} for x in (docs.coalesce(1), docs.repartition(7)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-5 * abs(a[k]) for k in a)


@pytest.mark.parametrize("c, d, a, near", [(3000, 0.5, 300.0, 0.001), (2000, 0.8, 150.0, 0.03), (2500, 0.2, 500.0, 0.001)])
def test_great_tables_follow_the_exact_sums(c, d, a, near):
    import numpy as np

    from airshed.llm import pitman_yor as P

    log_s = np.full(c + 1, -np.inf)  # log S_d(n, t) by n
    log_s[1] = 0.0
    t = np.arange(1, c + 1)
    for n in range(1, c):
        stay = n - d * t
        with np.errstate(divide="ignore"):
            log_s[1:] = np.logaddexp(log_s[:-1], np.where(stay > 0, log_s[1:] + np.log(np.maximum(stay, 1e-300)), -np.inf))
    p = log_s[1:] + t * np.log(a)
    p = np.exp(p - p.max())
    p /= p.sum()
    k = 5000
    mode, spread = P.likely_tables(np.array([float(c)]), np.array([a]), d)
    assert abs(mode[0] - t[p.argmax()]) < 0.3 * spread[0] and mode[0] >= P.FAR and abs(spread[0] ** 2 / (p @ t**2 - (p @ t) ** 2) - 1) < 0.05
    found = P.great_tables(np.full(k, float(c)), np.full(k, a), d, (np.arange(k) + 0.5) / k)
    assert np.abs(np.cumsum(np.bincount(found, minlength=c + 1)[1:] / k) - np.cumsum(p)).max() < near
    assert (P.sample_tables(np.full(3, c), np.full(3, a), d, np.random.default_rng(0), np.full(3, 0.5)) == found[k // 2]).all()
