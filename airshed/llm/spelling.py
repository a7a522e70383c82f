"""Spelling variants: words one edit apart, joined on asymmetric q-chunks.

Of two words one edit apart, the shorter (of equal ones either) is cut into two disjoint
chunks, its halves; one edit leaves one of them whole, and it occurs among the positional
grams of the other word at the same place or one further.  A chunk that is shared stands at
the start or at the end of both words, so what is left of the two is again one edit apart:
a chunk that many words share is joined not by itself but together with a chunk of what it
leaves, halved in turn.  Each round joins the selective keys and refines the others; at the
latest, the part left open is one character long, and then a key's words differ in that
character alone.  So no group of words is paired out, and the joined pairs are verified by
their edit distance.

Words, counts, keys and pairs are distributed rows throughout, and hot keys are counted by
partial aggregates.  Texts are read once.

Cases: a null text has no words; a null doc_id counts as an empty id in the crc.  Rows that
repeat are counted again.  Long texts give their words like others.  Ties between forms go
to the smallest word in code-point order.  Extra columns are ignored.  An empty table, or
one without such words, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.llm.common import Scratch, read, with_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, TWICE, TIMES = 7, 2, 10
DAMAGED = 31
#: A key with more rows than this is refined.
HOT = 64


def words(docs: DataFrame, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """word, n: the runs of letters of at least ``least`` code points (after the fixed damage) that occur ``twice`` at least."""
    with_columns(docs, "doc_id", "text")
    # A run only ever gets shorter, so shorter ones needn't be looked at; the quantifier still takes whole runs.
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    each = each.select(F.when(h % DAMAGED == 0, damaged).otherwise(F.col("run")).alias("word"))
    return each.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= twice)


# ---------------------------------------------------------------- chunks and grams

CHUNK, GRAM = 0, 1
ENTRY = "struct<side:int,size:int,start:int,stop:int>"


def _key(word: Column, e: Column) -> Column:
    """What is shared: the chunk side's word outside its open part [start, stop).  A gram word that is longer by one leaves one more open."""
    more = F.length(word) - e["size"]
    kept = F.concat(F.substring(word, F.lit(1), e["start"]), F.lit("\x00"), F.substring(word, e["stop"] + more + 1, F.length(word)))
    return F.xxhash64(e["size"], e["start"], e["stop"], kept)


def _halves(e: Column) -> Column:
    """The entry with either half of its open part closed: that half is the next chunk."""
    middle = F.floor((e["start"] + e["stop"]) / 2).cast("int")
    left, right = [F.struct(e["side"].alias("side"), e["size"].alias("size"), a.alias("start"), b.alias("stop")) for a, b in ((e["start"], middle), (middle, e["stop"]))]
    return F.array(left, right).cast(f"array<{ENTRY}>")


def _entries(vocabulary: DataFrame) -> DataFrame:
    """word, n, e: each word as chunk side of its own size, and as gram side of that and of one less."""
    size = F.length("word")
    whole = [F.struct(F.lit(side).alias("side"), s.alias("size"), F.lit(0).alias("start"), s.alias("stop")) for side, s in ((CHUNK, size), (GRAM, size), (GRAM, size - 1))]
    each = vocabulary.select("word", "n", F.explode(F.array(*whole).cast(f"array<{ENTRY}>")).alias("w"))
    return each.select("word", "n", F.explode(_halves(F.col("w"))).alias("e")).withColumn("key", _key(F.col("word"), F.col("e")))


def near_pairs(vocabulary: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """a, a_n, b, b_n: each pair of the words that are one edit apart, once."""
    entries, found, level = _entries(vocabulary), [], 0
    while True:
        entries = scratch.keep(entries, f"entries{level}")
        sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("e.side").alias("least"), F.max("e.side").alias("most"), F.max(F.col("e.stop") - F.col("e.start")).alias("open"))
        sizes = scratch.keep(sizes.where(F.col("least") < F.col("most")).select("key", ((F.col("rows") > hot) & (F.col("open") > 1)).alias("hot")), f"sizes{level}")
        cold = entries.join(sizes.where(~F.col("hot")).select("key"), "key", "left_semi")
        side = [cold.where(F.col("e.side") == s).select("key", F.col("word").alias(w), F.col("n").alias(f"{w}_n")) for s, w in ((CHUNK, "a"), (GRAM, "b"))]
        # Words of one size meet twice, as either side.
        pairs = side[0].join(side[1].hint("merge"), "key").where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
        found.append(scratch.keep(pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n"), f"pairs{level}"))
        if sizes.where("hot").isEmpty():
            break
        refined = entries.join(sizes.where("hot").select("key"), "key", "left_semi").select("word", "n", F.explode(_halves(F.col("e"))).alias("e"))
        entries, level = refined.withColumn("key", _key(F.col("word"), F.col("e"))), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()  # an insertion between or beside equal characters has several places


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: the end of each chain of (word, form); each round doubles the steps taken."""
    chains, k = scratch.keep(forms.select("word", F.col("form").alias("root")), "chain0"), 0
    while True:
        ahead = chains.select(F.col("word").alias("at"), F.col("root").alias("ahead"))
        step = chains.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        step = scratch.keep(step, f"chain{k + 1}")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        chains, k = step.select("word", "root"), k + 1


def variants(docs: DataFrame, least: int = LEAST, twice: int = TWICE, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    scratch = Scratch(docs.sparkSession, "spelling")
    vocabulary = scratch.keep(words(docs, least, twice), "words")
    pairs = scratch.keep(near_pairs(vocabulary, scratch), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    strong = -F.col("best.less") >= times * F.col("n")
    out = vocabulary.join(near, "word", "left").select(
        "word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n")
    )
    out = scratch.keep(out, "forms")
    ends = roots(out.where(F.col("form").isNotNull()), scratch)
    out = out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return scratch.finish(out)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE bits AS (
  SELECT k, k AS c, 0 AS step FROM (SELECT unnest(range(256)) AS k) t
  UNION ALL SELECT k, xor(c >> 1, 3988292384 * (c & 1)), step + 1 FROM bits WHERE step < 8
), crc_table AS (
  SELECT k, c FROM bits WHERE step = 8
), runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) t
  WHERE length(run) >= 7 GROUP BY doc_id, run
), crc AS (
  SELECT doc_id, run, times, hex(encode(doc_id::VARCHAR || ':' || run)) AS bytes, 0 AS pos, 4294967295::BIGINT AS c FROM runs
  UNION ALL
  SELECT doc_id, run, times, bytes, pos + 2, xor(crc.c >> 8, t.c)
  FROM crc JOIN crc_table t ON t.k = xor(crc.c & 255, ('0x' || substr(bytes, pos + 1, 2))::BIGINT) WHERE pos < length(bytes)
), hashed AS (
  SELECT run, times, xor(c, 4294967295) AS h FROM crc WHERE pos = length(bytes)
), damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), holes AS (
  SELECT word, n, pos, substr(word, 1, pos) || substr(word, pos + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS pos FROM words) t
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN holes b ON b.rest = a.word
), ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near
), forms AS (
  SELECT w.word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1
), chains AS (
  SELECT word, word AS pos FROM forms
  UNION ALL SELECT chains.word, form FROM chains JOIN forms ON forms.word = pos WHERE form IS NOT NULL
)
SELECT f.word, f.form, c.pos AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c ON c.word = f.word JOIN forms goal ON goal.word = c.pos AND goal.form IS NULL
"""
