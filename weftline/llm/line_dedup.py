"""Line dedup with levelled sorted runs of line hashes.

Every batch of documents becomes a run: one entry for each distinct line key,
sorted by the key's 128-bit hash, with the number of documents that hold it and
the largest of their ids.  A level that is full is compacted: its runs are
merged into one run of the next level.  A new batch is merge-joined with the
runs: an anti-join finds the keys that no run holds, which become its own run,
and what it has of the other keys is kept beside the runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import id_filter
from weftline.session import discard, written

# The white space that is stripped from a line's ends, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_facts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40) -> DataFrame:
    """``doc, body, pos, h1, h2`` of every line whose key has at least *min_chars* code points.

    *body* is a hash of the whole text, so that rows of one id with different texts stay apart.
    """
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    keys = rows.select("doc", "body", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


class LineRuns:
    """Levels of sorted runs in the shared folder; each run is a Parquet table ``h1, h2, n_docs, keeper``.

    A key is in one run only, with what its first batch had of it.  What later batches have of keys that
    a run holds is kept in ``repeats``, which has no other keys.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []

    @staticmethod
    def _counted(facts: DataFrame) -> DataFrame:
        """A batch's distinct keys; a document belongs to one batch only."""
        once = facts.groupBy(*HASH, "doc").agg(F.lit(1).cast("bigint").alias("n_docs"))
        return once.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("doc").alias("keeper"))

    def add(self, facts: DataFrame) -> None:
        """Merge a batch with the runs: the keys that they lack become a run, the others are repeats."""
        if not self.runs():
            self._store(0, self._counted(facts))
            return
        batch = written(self._counted(facts), "lines-batch")
        self.repeats.append(written(reduce(DataFrame.unionByName, [batch.join(run.select(*HASH).hint("merge"), list(HASH), "left_semi") for run in self.runs()]), "lines-repeats"))
        self._store(0, self.unseen(batch))
        discard(self.spark, batch)

    def _store(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(written(run.sortWithinPartitions(*HASH), f"lines-level{level}"))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._store(level + 1, reduce(DataFrame.unionByName, runs).repartition(*HASH))
            discard(self.spark, *runs)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def entries(self) -> DataFrame | None:
        """All keys with their documents; None before the first batch."""
        if not self.runs():
            return None
        found = reduce(DataFrame.unionByName, [*self.runs(), *self.repeats])
        return found.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def unseen(self, facts: DataFrame) -> DataFrame:
        """The rows of a batch whose keys no run holds yet."""
        for run in self.runs():
            facts = facts.join(run.select(*HASH).hint("merge"), list(HASH), "left_anti")
        return facts


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop the lines that many documents share, except in the document of the largest id.

    A line's key is the line stripped of white space with A-Z lower-cased.  Keys of at least
    *min_chars* code points that at least *min_docs* documents (distinct ids) hold lose all their
    lines but those of the largest id.  Returns all columns of *docs*, the text replaced, and
    ``n_lines`` (before) and ``n_dropped``; columns of these names are replaced.  A null text is one
    empty line and becomes an empty text; rows with a null id are one document, below all others;
    repeated rows stay repeated; an empty table stays empty.

    Shuffles: three longs and a position per long line, and the texts that may lose a line by their id.
    """
    spark = docs.sparkSession
    carry = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    facts = written(line_facts(docs, key, text, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")), "line-facts", "batch")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(facts.where(F.col("batch") == b).select("doc", *HASH))
    shared = written(runs.entries().where(F.col("n_docs") >= min_docs), "lines-shared")
    # Keys with a thousandth of all these lines are at most a thousand: they are broadcast, so that no task gets all rows of one line.
    total = int(shared.agg(F.sum("n_docs")).first()[0] or 0)
    hot = F.broadcast(shared.where(F.col("n_docs") * 1000 >= total).select(*HASH, "keeper"))
    cold = shared.where(F.col("n_docs") * 1000 < total).select(*HASH, "keeper")
    held = facts.join(hot, list(HASH)).unionByName(facts.join(hot, list(HASH), "left_anti").join(cold.hint("merge"), list(HASH)))
    gone = held.where(~F.col("doc").eqNullSafe(F.col("keeper")))
    gone = written(gone.groupBy("doc", "body").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "lines-gone")
    # A byte for each line up to the last that goes: 1 for those that go.
    zeros = lambda p, i: F.repeat(F.lit("0"), p - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1)
    marks = gone.select(F.col("doc").alias("gone_doc"), F.col("body").alias("gone_body"), F.size("gone").cast("bigint").alias("n_gone"), F.array_join(F.transform("gone", lambda p, i: F.concat(zeros(p, i), F.lit("1"))), "").cast("binary").alias("marks"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("body"))
    may = id_filter.maybe(gone, "doc", rows["doc"])
    cut = rows.where(may).join(marks.hint("merge"), F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("body") == F.col("gone_body")), "left")
    out = cut.select("row", "n_gone", "marks").unionByName(rows.where(~may).select("row", F.lit(None).cast("bigint").alias("n_gone"), F.lit(None).cast("binary").alias("marks")))
    old = F.coalesce(F.col("row")[text], F.lit(""))
    stays = F.filter(F.split(old, "\n", -1), lambda line, i: F.substring("marks", i + 1, F.lit(1)) != F.lit(b"1"))
    new = F.when(F.col("n_gone").isNull(), old).otherwise(F.array_join(stays, "\n"))
    n_lines = (F.length(old) - F.length(F.translate(old, "\n", "")) + 1).cast("bigint")
    return out.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in carry], n_lines.alias("n_lines"), F.coalesce("n_gone", F.lit(0)).cast("bigint").alias("n_dropped"))
