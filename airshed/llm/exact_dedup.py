"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table ``(digest, keep_id, keep_rid, n, batch)`` bucketed and sorted by
digest, so each new batch meets it in a sort-merge anti-join that reads the index bucket
by bucket without shuffling it; digests that it lacks are appended.  Its files lie in a
shared folder, where later sessions find them.  When appends have left many files, they
are written anew as one sorted file for each bucket.

Cases: a null text counts as empty; white space runs compare equal, so blank texts of any
length are one group.  Null doc_ids sort after all others.  Rows that repeat a doc_id are
rows of their own: of equal rows one stays.  Extra columns are ignored by ``decisions`` and
kept by ``keep_first``.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.llm.common import WHITE, Scratch, keep_rows, keyed, read
from airshed.session import checkpoint_dir

INDEX = "digest binary, keep_id bigint, keep_rid bigint, n bigint, batch string"
#: Files a bucket has on average when the index is compacted.
MAX_FILES = 16
#: Empty file that a compaction writes last.
COMPLETE = "_COMPLETE"


def digest(text):
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ").cast("binary"), 256)


class DigestIndex:
    """A persistent set of digests, bucketed and sorted by digest, with one writer at a time.

    ``path`` is a folder that all executors see, by default one named after the table below
    ``spark.checkpoint.dir``.  Its subfolders are generations, ``g<number>-b<buckets>``: the
    last complete one counts, and its number of buckets holds whatever ``buckets`` says."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.table = spark, table
        self.path = path or f"{checkpoint_dir(spark).rstrip('/')}/llm/index/{table}"
        found = [(int(g), int(b), name) for name in self._names("") for g, b in re.findall(r"^g(\d+)-b(\d+)$", name)]
        whole = [(g, b) for g, b, name in found if g == 0 or COMPLETE in self._names(name)]
        self.generation, self.buckets = max(whole, default=(0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self._attach()

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, files = self._at(name)
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def _folder(self, generation: int) -> str:
        return f"g{generation}-b{self.buckets}"

    def _attach(self) -> None:
        """Point the session's table at the current generation."""
        place = f"{self.path}/{self._folder(self.generation)}".replace("\\", "\\\\").replace("'", "\\'")
        if self.spark.catalog.tableExists(self.table) and self.spark.catalog.getTable(self.table).tableType != "EXTERNAL":
            raise ValueError(f"{self.table} is another table")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.spark.sql(f"CREATE TABLE {self.table} ({INDEX}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, found: DataFrame, batch: str) -> None:
        """Append the digests of ``found`` (one row for each) that the index lacks.  A batch that failed can be added again."""
        known = self.rows().select("digest")
        new = found.join(known.hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        new.select("digest", "keep_id", "keep_rid", "n", "batch").write.insertInto(self.table)
        if len(self._names(self._folder(self.generation))) > MAX_FILES * self.buckets:
            self.compact()

    def compact(self) -> None:
        """Write the index anew with one sorted file for each bucket, and delete the former files."""
        following, former = f"{self.table}_{uuid.uuid4().hex}", self._folder(self.generation)
        if not self._names(former):
            return
        path, files = self._at(self._folder(self.generation + 1))
        files.delete(path, True)  # what a failed compaction left
        # A partition is a bucket: both are the digest's hash modulo their number.  (The files are read as they are:
        # from the bucketed table, the planner would leave out the exchange and read without buckets all the same.)
        whole = self.spark.read.schema(INDEX).parquet(f"{self.path}/{former}").repartition(self.buckets, "digest")
        whole.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", path.toString()).saveAsTable(following)
        self.spark.sql(f"DROP TABLE {following}")  # the files stay
        files.create(self._at(f"{path.getName()}/{COMPLETE}")[0]).close()
        self.generation += 1
        self._attach()
        old, files = self._at(former)
        files.delete(old, True)

    def drop(self) -> None:
        """Remove the index and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        path, files = self._at("")
        files.delete(path, True)


def _groups(digests: DataFrame) -> DataFrame:
    """One row for each digest: its first document and its number of rows."""
    return digests.groupBy("digest").agg(F.min_by("doc_id", "rid").alias("keep_id"), F.min("rid").alias("keep_rid"), F.count(F.lit(1)).alias("n"))


def _decide(rows: DataFrame, scratch: Scratch, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 of keyed rows."""
    spark = rows.sparkSession
    if index is None:
        index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", path=f"{scratch.path}/index")
        try:
            return _decide(rows, scratch, index, batch)
        finally:
            index.drop()
    batch = batch or uuid.uuid4().hex
    digests = scratch.keep(rows.select("rid", "doc_id", F.unhex(digest(F.col("text"))).alias("digest")), "digests")
    groups = scratch.keep(_groups(digests), "groups")
    index.add(groups, batch)
    held = index.rows().select("digest", "keep_id", "keep_rid", "batch")
    stays = scratch.keep(
        groups.select("digest", "n").join(held.hint("merge"), "digest").select("digest", "n", "keep_id", F.when(F.col("batch") == batch, F.col("keep_rid")).alias("keep_rid")), "stays"
    )
    # Both sides are read from written tables, so both are shuffled and a hot digest's rows can be split.
    out = digests.join(stays.hint("merge"), "digest").select(
        "rid", "doc_id", "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
    return scratch.finish(out)


def decisions(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document.

    With an ``index`` of earlier batches, a document whose text it holds is dropped in favour
    of that batch's document (group_size still counts this batch's rows); new digests are
    appended.  Without one, a fresh index serves this run alone."""
    scratch = Scratch(docs.sparkSession, "exact")
    return _decide(keyed(docs, scratch), scratch, index, batch).drop("rid")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that ``decisions`` keeps, with all their columns."""
    return keep_rows(docs, "exact-rows", lambda rows: _decide(rows, Scratch(docs.sparkSession, "exact"), None, None).where("kept"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
