"""URL rules, tokenising, extraction, decontamination, classifiers, language model, pipeline."""

import hashlib
import math
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import frame
from harness import compare, duck_connect

from airshed.llm import decontaminate, html_text, piece_bpe, pitman_yor, quality, toxicity, url_filter
from airshed.llm.queries import ORACLES, QUERIES

# ------------------------------------------------------------------ registered queries


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_small, name):
    ok, said = compare(QUERIES[name](spark, sf_small), duck_connect(sf_small), ORACLES[name])
    assert ok, said


# ------------------------------------------------------------------ URL rules


def judged(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    labels = ["com", "net", "example", "a", "b", "blog", "x-y"]
    rules = {}
    for _ in range(120):
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
        path = "".join("/" + rng.choice(["en", "de", "e"]) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/"])
        rules.setdefault((host, path), rng.choice(["allow", "block"]))
    rows = [(h, p, v) for (h, p), v in rules.items()]
    urls = [None, "", "no scheme", "http://", "://", "HTTP://COM", "http://com?x://net/", "http://com#f", "a\nb://net/\nen"]
    for _ in range(600):
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5)))
        urls.append(f"http://{host}" + "".join("/" + rng.choice(["en", "de", "e", ""]) for _ in range(rng.randint(0, 5))) + rng.choice(["", "/", "?q=/en", "#en"]))
    urls += ["http://hot.com/en/"] * 500
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rows + [(None, "/", "block"), ("", "/", "block"), ("com", "/", None), ("null.path", None, "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, table).collect()}
    assert got == {k: judged(u, rows + [("null.path", "", "block")]) for k, u in enumerate(urls)}


def test_url_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules).collect()} == {"allow"}
    some = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    assert url_filter.filter_urls(pages.limit(0), some).count() == 0


def test_url_conflicting_rules_block(spark):
    rules = spark.createDataFrame([("a.b", "/", "allow"), ("A.B", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.a.b/")], "page_id long, url string")
    assert url_filter.filter_urls(pages, rules).first()["verdict"] == "block"


# ------------------------------------------------------------------ SentencePiece


@pytest.fixture(scope="module")
def model():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = piece_bpe.tokenizer_path()
    return piece_bpe.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(model, documents):
    own, library = model
    rng = random.Random(4)
    letters = list("abcdefth e  .,\n▁é　的是了在x\t\x00😀Ａ") + [own.piece[i].replace("▁", " ") for i in rng.sample(range(300, 32000), 300)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [t or "" for _, t, *_ in documents]
    texts += [" " * k + "a" + " " * (k // 2) for k in range(100)] + ["x" * 3000, "的" * 500, "\u0301" * 40]
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text) == ids and own.coded(text) == (",".join(map(str, ids)), library.decode(ids)), text[:80]
        assert own.decode(ids) == library.decode(ids)


def test_encode_documents(spark, model, odd):
    _, library = model
    got = piece_bpe.encode_documents(frame(spark, odd, extra=True), piece_bpe.tokenizer_path()).collect()
    want = []
    for d, t, *_ in odd:
        ids = library.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    texts = piece_bpe.encode_documents(frame(spark, odd), piece_bpe.tokenizer_path(), texts=True)
    assert all((r["decoded"] or "") == r["again"] for r in piece_bpe.decode_documents(texts.withColumnRenamed("decoded", "kept"), piece_bpe.tokenizer_path()).withColumnRenamed("decoded", "again").withColumnRenamed("kept", "decoded").collect())
    assert piece_bpe.encode_documents(frame(spark, []), piece_bpe.tokenizer_path()).count() == 0


# ------------------------------------------------------------------ HTML

LONG = "The river runs to the sea and it is as long as the road that the people of the town take to the market in the spring of the year. "


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("no markup", ""),
        ("<p>" + LONG * 2, (LONG * 2).strip()),
        ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>A title</h1><p>One &amp; two&nbsp;three<br>four</p><p>x <b>y</b>z<script>var a='</p>';</script></p></article><footer>(c)</footer></body>", "A title\nOne & two three four\nx yz"),
        (f"<header><h1>Site</h1></header><div class='cookie-notice'>{LONG}</div><main><article><header><h1>Head</h1></header><p>{LONG}</p><aside>{LONG}</aside><div class=ad-slot>{LONG}</div><form><p>{LONG}</p></form><section id=comments><p>{LONG}</p></section></article></main><div class='sidebar'>{LONG}</div>", "Head\n" + LONG.strip()),
        (f"<div id=menu><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div><h2>Short head</h2><p>{LONG * 3}</p><p>Short in between.</p><p>{LONG * 3}</p><div><a href=c>{LONG}</a></div><p>Tail</p>", f"Short head\n{(LONG * 3).strip()}\nShort in between.\n{(LONG * 3).strip()}"),
        ("<article><p>unclosed <i>tags <p>second <!-- note --> part<ul><li>a<li>b</ul>", "unclosed tags\nsecond part\na\nb"),
        ("<article><p>same</p><p>same</p></article>", "same\nsame"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_second_pass_labels():
    g, b, n, s = html_text.GOOD, html_text.BAD, html_text.NEAR, html_text.SHORT
    assert html_text.second_pass([s, g, s, s, b, s], b) == [True, True, True, False, False, False]
    assert html_text.second_pass([g, n, b], b) == [True, True, False]
    assert html_text.second_pass([g, s, b], b) == [True, False, False]
    assert html_text.second_pass([s, n], g) == [True, True]


def test_extract(spark):
    page = f"<article><p>{LONG}</p><p>é &copy;</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, "x"), (2, "v", "<p>" * 20000 + "<div " * 500, "x"), (3, "w", f"<article>{'<p>' + LONG + '</p>'}" * 3000, "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r["page_id"], r["url"]) for r in got] == [r[:2] for r in rows]
    assert got[0]["text"] == got[1]["text"] == LONG.strip() + "\né ©" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[2]["text"] == "" and got[4]["text"].count("\n") == 2999


def test_real_pages_give_their_articles(spark, sf_small):
    for r in QUERIES["op7_html_text"](spark, sf_small).join(spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        assert r["text"].count("\n") + 1 >= article.count("</p>")
        assert "track(" not in r["text"] and r["html"].split("<footer>")[1][:12] not in r["text"]


def plain_labels(labels, default, headings):
    """The second pass again, each open block looking for its neighbours by itself."""
    g, b, n = html_text.GOOD, html_text.BAD, html_text.NEAR

    def beside(row, k):
        left = next(((k - j, row[j]) for j in range(k - 1, -1, -1) if row[j] in (g, b)), None)
        right = next(((j - k, row[j]) for j in range(k + 1, len(row)) if row[j] in (g, b)), None)
        return left, right

    middle = []
    for k, x in enumerate(labels):
        around = [y[1] for y in beside(labels, k) if y]
        middle.append(x if x != n else default if not around else g if g in around else b)
    out = []
    for k, x in enumerate(middle):
        left, right = beside(middle, k)
        if x not in (g, b):
            if not (left and right):
                x = (left or right or (0, default))[1]
            elif headings[k]:
                x = right[1]
            elif left[0] == right[0]:
                x = g if left[1] == right[1] == g else b
            else:
                x = min(left, right)[1]
        out.append(x == g)
    return out


def test_second_pass_equals_the_plain_one(rng):
    kinds = [html_text.GOOD, html_text.BAD, html_text.NEAR, html_text.SHORT]
    for _ in range(3000):
        n = rng.randint(0, 9)
        labels, headings = rng.choices(kinds, k=n), [rng.random() < 0.2 for _ in range(n)]
        default = rng.choice(kinds[:2])
        assert html_text.second_pass(labels, default, headings) == plain_labels(labels, default, headings)


class PlainBlocks(HTMLParser):
    """Texts of a tidy page's blocks by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.skip = [], [], 0

    def cut(self):
        if text := " ".join("".join(self.now).split()):
            self.out.append(text)
        self.now = []

    def handle_starttag(self, name, attributes):
        if name == "br":
            self.now.append(" ")
        if name in html_text.BLOCKS:
            self.cut()
        self.skip += name in ("head", "script", "style")

    def handle_endtag(self, name):
        if name in html_text.BLOCKS:
            self.cut()
        self.skip -= name in ("head", "script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def test_pages_by_the_two_passes_alone(spark, sf_small):
    """Blocks equal a plain parser's; without the article's marks the rules find the same text."""
    for (page,) in spark.read.parquet(f"{sf_small}/pages.parquet").select("html").collect():
        plain = PlainBlocks()
        plain.feed(page or "")
        plain.cut()
        assert [b.text for b in html_text.blocks(page or "")] == plain.out
        unmarked = (page or "").replace("<article", "<div").replace("</article", "</div")
        assert html_text.main_text(unmarked) == html_text.main_text(page)


def test_odd_pages_take_linear_time():
    units = ['<a "', "<div class=x></p>", "<a ", '<a "> "', "<div class=ad>x", "<div class=ad><main>x", "<!", "<!--", "&#9", "<a x x=", "<p x='", "<title>", "&"]
    for unit in units:
        began = time.process_time()
        html_text.main_text(unit * (1_000_000 // len(unit)))
        assert time.process_time() - began < 20, unit
    assert html_text.main_text(f"<article><p {'a' * 300_000}>x</p></article>") == "x"


def test_references_with_long_numbers():
    for raw, text in (("&#" + "0" * 6000 + "65;", "A"), ("&#x" + "0" * 9 + "41;", "A"), ("&#" + "9" * 6000 + ";", "\ufffd"), ("&#x" + "f" * 5000 + ";", "\ufffd"), ("&#00000000000;", "\ufffd"), ("&#12345", "\u3039")):
        assert html_text.main_text(f"<article><p>a{raw}</p></article>") == "a" + text


def test_extract_with_clashing_columns(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x", 5, True)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, kept boolean")).collect()
    assert got[0].asDict() == {"page_id": 1, "url": "u", "text": LONG.strip(), "n_chars": len(LONG.strip())}


# ------------------------------------------------------------------ decontamination


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(300):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert decontaminate.best_end(decontaminate._masks(p), len(p), t)[0] == distance_in(p, t)


def test_matches_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(5, 40)))) for k in range(12)] + [(50, None), (51, ""), (52, "short"), (53, " x " * 40)]
    items.append((54, items[0][1]))
    docs = []
    for k in range(80):
        text = " ".join(word() for _ in range(60))
        if k % 2:
            planted = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, len(planted) // 9)):
                planted[rng.randrange(len(planted))] = rng.choice("abcdefgh ")
            text = text[:100] + " " + "".join(planted).upper().replace(" ", " \n") + " " + text[100:]
        docs.append((k, text, None, None, None))
    docs += [(100, None, None, None, None), (101, "", None, None, None), (None, items[1][1], None, None, None), (102, "x " * 5000, None, None, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t, *_ in docs:
        for i, x in items:
            p, text = decontaminate.normalised(x), decontaminate.normalised(t)
            if len(p) >= decontaminate.MIN_CHARS and (n := distance_in(p, text)) <= len(p) * decontaminate.ERRORS // 100:
                want.add((d, i, n))
    for block in (decontaminate.BLOCK_BYTES, 300):
        rows = decontaminate.matches(frame(spark, docs, extra=True), benchmark, block_bytes=block).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in rows} == want and len(rows) == len(want)
        texts = {d: decontaminate.normalised(t) for d, t, *_ in docs}
        for r in rows:
            p = decontaminate.normalised(dict(items)[r["item_id"]])
            assert distance_in(p, texts[r["doc_id"]][r["start"] : r["end"]]) == r["distance"]
    left = decontaminate.keep_clean(frame(spark, docs, extra=True), benchmark, block_bytes=300)
    assert left.columns == frame(spark, docs, extra=True).columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((d for d, *_ in docs if d not in {w[0] for w in want}), key=str)
    assert decontaminate.matches(frame(spark, []), benchmark).count() == 0
    assert decontaminate.matches(frame(spark, docs), benchmark.limit(0)).count() == 0


# ------------------------------------------------------------------ classifiers


def held_out(spark, sf, name, label, m, r):
    got = {x["doc_id"]: x for x in QUERIES[name](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(x["held_out"] == (zlib.crc32(str(d).encode()) % m == r) and x["predicted"] == (x["score"] >= 0.5) and 0 <= x["score"] <= 1 for d, x in got.items())
    rows = [(got[x["doc_id"]]["predicted"], x[label]) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[x["doc_id"]]["held_out"]]
    return sum(a == b for a, b in rows) / len(rows)


def test_quality_held_out_accuracy(spark):
    assert held_out(spark, "/root/testdata/sf0.01", "op6_quality", "quality", 3, 1) > 0.95


def test_toxicity_held_out_accuracy(spark):
    assert held_out(spark, "/root/testdata/sf0.01", "op9_toxicity", "toxic", 5, 0) > 0.95


def test_byte_net_equals_plain_convolution(rng):
    gen = np.random.default_rng(0)
    net = quality.ByteNet(gen.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), gen.normal(size=quality.FILTERS).astype(np.float32), gen.normal(size=2 * quality.FILTERS).astype(np.float32), 0.1)
    texts = ["", "a", "abc", "é" * 200, "x" * 255, "y" * 256, "z" * 257, "the end of it " * 2000, None]
    got = net.logits(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        n = max(1, len(raw))
        data = np.zeros(n + quality.WIDTH - 1, np.uint8)
        data[: len(raw)] = raw
        windows = sum(net.table[j][data[j : j + n]].astype(np.float64) for j in range(quality.WIDTH)) + net.bias
        chunks = np.array([np.maximum(windows[i : i + quality.CHUNK].max(axis=0), 0) for i in range(0, n, quality.CHUNK)])
        want = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.head.astype(np.float64) + net.shift
        assert abs(got[k] - want) < 1e-3
    alone = [net.logits(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(alone, got, atol=1e-4)


def test_wrappers_and_other_languages_keep_their_text():
    text = "The river is as long as the road that leads to the sea, and it was there before the town. " * 4
    want = " ".join(text.split())
    side = '<div class="sidebar">' + "Some of the links that we have for you are in this list of all the things to read. " * 2 + "</div>"
    for page in (
        f'<div class="content-sidebar-wrap"><main><p>{text}</p></main></div>',
        f'<div class="has-sidebar"><p>{text}</p>{side}</div>',
        f'<article class="post comments-open"><p>{text}</p></article>',
        f'<form action="x"><div><p>{text}</p></div></form>',
        f'<div class="widget"><article><p>{text}</p></article></div>{side}',
    ):
        assert html_text.main_text(f"<html><body>{page}</body></html>") == want
    russian = "Река течёт через старый город и впадает в холодное море далеко на севере страны. " * 4
    assert html_text.main_text(f"<body><p>{russian}</p></body>") == russian.strip()


def test_quality_without_both_labels(spark, odd):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int")
    net = quality.train(frame(spark, odd), labels)
    assert net.score(pa.array(["x"]))[0] > 0.99
    none = quality.train(frame(spark, odd), labels.limit(0))
    assert abs(none.score(pa.array(["x"]))[0] - 0.5) < 1e-9
    kept = quality.keep_good(frame(spark, odd, extra=True), net)
    assert kept.count() == len(odd) and kept.columns == frame(spark, odd, extra=True).columns
    assert quality.train(frame(spark, []), labels).shift == none.shift


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    from airshed.llm.common import labelled_sample

    docs = frame(spark, [(k, f"t{k}" * 10, None, None, None) for k in range(400)] + [(None, "n", None, None, None)])
    labels = spark.createDataFrame([(k, k % 2 if k % 7 else None) for k in range(400)] + [(None, 1), (2, 1)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", (3, 1), 50, 1 << 20)
    ids = [int(t.split("t")[1]) for t, _ in rows]
    assert len(ids) == 100 and all(zlib.crc32(str(k).encode()) % 3 != 1 and k % 7 for k in ids)
    assert dict(zip(ids, (y for _, y in rows))).get(2, 0) == 0
    assert 0 < sum(len(t) for t, _ in labelled_sample(docs, labels, "quality", (3, 1), 50, 800)) <= 800


def test_one_long_text_does_not_end_the_sample(spark):
    from airshed.llm.common import labelled_sample

    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    for long in ids[:8]:  # some of them early in hash order
        docs = frame(spark, [(k, f"t{k}" * (1 if k != long else 1000), None, None, None) for k in ids])
        rows = labelled_sample(docs, labels, "quality", (3, 1), 50, 1500)
        assert sorted(t for t, _ in rows) == sorted(f"t{k}" for k in ids if k != long)
    docs = frame(spark, [(k, "x" * (10 if k % 2 else 2000), None, None, None) for k in ids])
    with pytest.raises(ValueError, match="fits"):
        labelled_sample(docs, labels, "quality", (3, 1), 50, 1500)


def test_counterfactual_penalty_levels_group_names():
    rng = random.Random(0)
    rows = []
    for k in range(600):
        text = " ".join(rng.choice(["river", "stone", "paper", "cloud", "green"]) for _ in range(8))
        toxic = k % 3 == 0
        named = "women" if toxic and rng.random() < 0.9 or rng.random() < 0.05 else "men"
        rows.append((f"{text} {'scoundrels ' if toxic else ''}{named}. {text}", int(toxic)))
    free, level = toxicity.fit(rows, penalty=0.0), toxicity.fit(rows, penalty=50.0)
    gap = lambda m: abs(m.logit("the women read") - m.logit("the men read"))
    assert gap(free) > 5 * gap(level) and gap(level) < 0.3
    assert level.score(pa.array(["the women read the paper", "the men read the paper"])) < [0.5, 0.5]
    assert level.score(pa.array(["those scoundrels and women"]))[0] > 0.5
    assert toxicity.swapped("Men walk. Rain falls.") == [("men walk.", "women walk."), ("men walk.", "girls walk."), ("men walk.", "boys walk.")]


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, odd), labels)
    assert all(s < 0.01 for s in model.score(pa.array(["x", "", None])))


# ------------------------------------------------------------------ language model


def test_language_model_contract(spark, odd):
    got = pitman_yor.score_documents(frame(spark, odd, extra=True)).collect()
    assert len(got) == len(odd)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + [""] for _, t, *_ in odd]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in odd]
    counts = {}
    for ws, h in zip(tokens, held):
        for w in ws if not h else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), h, len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws), 6)) for (d, *_), h, ws in zip(odd, held, tokens))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert pitman_yor.score_documents(frame(spark, [])).count() == 0


def test_markers_follow_all_counts_whatever_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "MARKERS", 2)
    # "of" is third in either chunk, but first of all
    rows = [(k, " ".join(["the"] * 5 * (k < 3) + ["sea"] * 5 * (k > 2) + ["fog"] * 4 * (k < 3) + ["elm"] * 4 * (k > 2) + ["of"] * 3), None, None, None) for k in (0, 2, 3, 4)]
    found = [set(pitman_yor.marker_classes(pitman_yor.encode(frame(spark, rows).coalesce(1), size))) for size in (1, 60, 1 << 20)]
    assert found == [{b"of", b"sea"}] * 3
    assert all(zlib.crc32(str(k).encode()) % 7 != 2 for k, *_ in rows)


def test_language_model_beats_the_base_on_held_out(spark, sf_small):
    rows = [r for r in QUERIES["op5_pitman_yor"](spark, sf_small).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_seating_follows_the_posterior():
    """The number of tables of one dish against its exact distribution, by Stirling-like sums."""
    c, d, a = 6, 0.4, 1.7
    weight = {1: 1.0}  # S_d(n, t), n = 1
    for n in range(1, c):
        weight = {t: weight.get(t - 1, 0) + (n - t * d) * weight.get(t, 0) for t in range(1, n + 2)}
    p = np.array([weight[t] * a ** (t - 1) for t in range(1, c + 1)])
    p /= p.sum()
    k = 6000
    counts, weights = np.full(k, c), np.full(k, a)
    sizes, dish = pitman_yor.first_seating(counts, weights)
    sizes, dish = pitman_yor.reseat(sizes, dish, counts, weights, d, np.random.default_rng(0), 60)
    assert np.bincount(dish, sizes, k).tolist() == counts.tolist() and sizes.min() >= 1
    found = np.bincount(np.bincount(dish, minlength=k), minlength=c + 1)[1:] / k
    assert np.abs(found - p).max() < 0.03


@pytest.mark.parametrize("c, d, a", [(2, 0.9, 0.3), (6, 0.4, 1.7), (80, 0.4, 20.0), (300, 0.6, 2.0), (80, 0.1, 500.0)])
def test_tables_are_drawn_from_the_posterior(c, d, a):
    weight = np.r_[0.0, np.full(c, -np.inf)]  # logarithms of S_d(n, t), t = 1 to c + 1
    for n in range(1, c):
        stay = n - d * np.arange(1, c + 2)
        weight = np.logaddexp(np.r_[-np.inf, weight[:-1]], np.where(stay > 0, weight + np.log(np.maximum(stay, 1e-300)), -np.inf))
    p = weight[:c] + np.arange(c) * math.log(a)
    p = np.exp(p - p.max())
    p /= p.sum()
    k = 6000
    found = np.bincount(pitman_yor.sample_tables(np.full(k, c), np.full(k, a), d, np.random.default_rng(0)), minlength=c + 1)[1:] / k
    assert np.abs(found - p).max() < 0.03 and abs((found - p) @ np.arange(c)) < 6 * math.sqrt(np.arange(c) ** 2 @ p / k)


def test_all_customers_of_a_frequent_word_are_seated_anew():
    """With ever more customers, the tables beside a great one become Poisson of mean a / d, whatever the first seating was."""
    c, a, d, k = 10**7, 2.0, 0.5, 2000
    t = pitman_yor.sample_tables(np.full(k, c), np.full(k, a), d, np.random.default_rng(0))
    assert abs(t.mean() - 5) < 0.3 and abs(t.var() - 4) < 0.6
    assert pitman_yor.sample_tables(np.array([0, 1]), np.ones(2), d, np.random.default_rng(0)).tolist() == [0, 1]


def test_spelling_is_a_probability():
    words = [b"ab", b"abc", b"b", b"abba", "é".encode(), b""]
    key, at = pitman_yor.trigrams(pa.array(words, pa.binary()))
    keys, inverse = np.unique(key, return_inverse=True)
    model = pitman_yor.Spelling(keys, np.bincount(inverse).astype(np.int64), np.random.default_rng(0))
    for a, b in ((256, 256), (256, ord("a")), (ord("a"), ord("b")), (ord("q"), ord("z"))):
        context = a * 257 + b
        p = model.back[context] * model.parent[b].copy()
        inside = model.keys // 257 == context
        p[model.keys[inside] % 257] += model.own[inside]
        assert abs(p.sum() - 1) < 1e-9
    assert np.bincount(at, minlength=len(words)).tolist() == [len(w) + 1 for w in words]


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, sf_small):
    import corpus_pipeline
    from conftest_llm import components_by_brute_force

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = set(text)
    net = quality.train(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    left = {d for d in left if net.score(pa.array([text[d]], pa.string()))[0] >= 0.5}
    seen = {}
    for d in sorted(left):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[d] or ""), d)
    left = set(seen.values())
    parts = components_by_brute_force([(d, text[d]) for d in sorted(left)])
    left = {d for d in left if parts[d][1] == d}
    items = [decontaminate.normalised(r["text"]) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    left = {d for d in left if not any(i in decontaminate.normalised(text[d]) for i in items)}
    out = corpus_pipeline.run(spark, sf_small)
    assert {r["doc_id"] for r in out.collect()} == left and 0 < len(left) < len(text)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_small).columns == docs.columns


def test_words_depend_on_the_words_before_them(spark):
    train, held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 != 2][:80], [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    words = [f"w{k}" for k in range(40)]
    text = lambda k, step: " ".join(words[(k + step * i) % 40] for i in range(40))
    rows = [(k, text(k, 1), None, None, None) for k in train] + [(held[0], text(3, 1), None, None, None), (held[1], text(3, 7), None, None, None), (held[2], "unseen words only", None, None, None)]
    got = {r["doc_id"]: r for r in pitman_yor.score_documents(frame(spark, rows)).collect()}
    assert abs(got[held[0]]["base_score"] - got[held[1]]["base_score"]) < 1e-9
    # the same words, but only the first text has the pairs of the training texts
    assert got[held[0]]["score"] > got[held[1]]["score"] + 40


def test_probabilities_of_a_context_add_up(spark, documents):
    from airshed.llm.common import Scratch

    scratch = Scratch(spark, "lm-test")
    counts = scratch.keep(pitman_yor.training_pairs(pitman_yor.encode(frame(spark, documents))), "counts")
    known, own, unknown, n, v = pitman_yor.learn(counts, scratch)
    known, own = known.toPandas(), own.toPandas()
    assert (known["c"].sum(), len(known)) == (n, v) and len(own) == counts.count()
    for k, u in enumerate(unknown, 1):
        assert abs(known[f"p{k}"].sum() + u - 1) < 1e-9
    back = known.set_index("word")[[f"b{k + 1}" for k in range(len(unknown))]].mean(axis=1)
    size = known.set_index("word")["size"]
    for before, mine in own.groupby("before")["own"].sum().items():
        assert abs(mine / (pitman_yor.STRENGTH + size[before]) + back[before] - 1) < 1e-9
    scratch.drop()


def test_pairs_that_occur_once_are_no_rows_and_scores_are_those_of_all_pairs(spark, monkeypatch):
    """The packed ranges give each document what the table of all pairs gives, and no stored table has a row for each single pair."""
    import random

    from airshed.llm.common import Scratch

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 150, 400]))) + " the sea the sea", None, None, None) for k in range(60)] + [(2, None, None, None, None)]
    docs = frame(spark, rows)
    scratch = Scratch(spark, "lm-test")
    counts = scratch.keep(pitman_yor.training_pairs(pitman_yor.encode(docs)), "counts")
    known, own, unknown, n, v = pitman_yor.learn(counts, scratch)
    word = {bytes(r["word"]).decode(): r for r in known.collect()}
    pair = {(bytes(r["before"]).decode(), bytes(r["word"]).decode()): r["own"] for r in own.collect()}
    once = counts.where("c = 1").count()
    scratch.drop()
    stored, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: (stored.append((out := keep(self, df, name)).count()), out)[1])
    # chunks of one document each, some without training, and of all
    for size in (1, 1 << 20):
        monkeypatch.setattr(pitman_yor, "encode", lambda d, f=pitman_yor.encode, size=size: f(d.coalesce(1), size))
        got = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in pitman_yor.score_documents(docs).collect())
        want = []
        for k, text, *_ in rows:
            tokens, score, before = [*(text or "").split(), ""], 0.0, ""
            for w in tokens:
                p = [word[w][f"p{i}"] if w in word else u for i, u in enumerate(unknown, 1)]
                b = [word[before][f"b{i}"] if before in word else 1.0 for i in (1, 2, 3)]
                customers = word[before]["size"] if before in word else 0
                score += math.log10(pair.get((before, w), 0.0) / (pitman_yor.STRENGTH + customers) + sum(x * y for x, y in zip(p, b)) / 3)
                before = w
            want.append((k, len(tokens), score))
        want.sort()
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(x[2] - y[2]) <= 1e-7 * abs(y[2]) for x, y in zip(got, want))
        monkeypatch.undo()
        monkeypatch.setattr(Scratch, "keep", lambda self, df, name: (stored.append((out := keep(self, df, name)).count()), out)[1])
    assert max(stored) < once
