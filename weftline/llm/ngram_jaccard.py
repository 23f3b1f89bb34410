"""N-gram Jaccard self-join by parity sketches.

A text's set of word shingles becomes a bit sketch: every shingle flips one
bit, so two sketches differ in at most as many bits as the sets' symmetric
difference has members.  Within a band of sizes a linked pair can differ in at
most ``d`` bits; of ``d + 1 + s`` blocks of the sketch, ``1 + s`` are then equal
in both, and documents that share a block are candidates.  A block is joined
by a 64-bit hash of its bits.  The slack ``s`` lets each document leave out its
blocks with the fewest bits, and then those whose buckets are the largest,
without losing a pair (see ``_kept_blocks`` and ``_buckets``).

Equal sets are one class.  In a bucket every class is first compared with one
other class, by exact intersection; classes that are linked become one
component.  What is left are pairs of different components in a bucket: those
whose whole sketches differ in few enough bits are candidates, and are verified
in a fixed number of turns of growing size; pairs that the links of a turn join
drop out of the next.  So a large group of near copies never makes all its
pairs, and pairs that only share a passage are never intersected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import id_filter
from weftline.llm.bytes_np import chunks, mix64, ngram_hashes, space_words
from weftline.llm.components import components, merged
from weftline.session import discard, written

#: Bits of one block of the sketch.
BLOCK_BITS = 4096
#: Bits and 64-bit words of the sketch that is compared as a whole.
SKETCH_BITS, SKETCH_WORDS = 1024, 16
#: Buckets with more classes than this may be left out, as far as the slack allows.
LARGE = 24
#: The columns that tell sets apart.
SET = ["n", "s1", "s2"]
#: Open pairs are verified in turns, each four times as large as the turns before it together.
TURNS = (1, 4, 16, 64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; with fewer words the whole sequence is one."""
    h, per_row, _, _ = space_words(data, offsets)
    grams, per = ngram_hashes(h, per_row, words)
    first, at = np.cumsum(per_row) - per_row, 0
    for i in range(len(per_row)):
        n = int(per[i])
        if n:
            yield np.unique(grams[at : at + n])
            at += n
        elif per_row[i]:
            short, _ = ngram_hashes(h[first[i] : first[i] + per_row[i]], per_row[i : i + 1], int(per_row[i]))
            yield mix64(short + per_row[i].astype(np.uint64))
        else:
            yield np.zeros(0, np.uint64)


class Bands:
    """Bands of set sizes for Jaccard similarity ``num / den``: linked sets lie in one band or in neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def blocks(self, band: int) -> tuple[int, int, int]:
        """For pairs whose smaller set lies in *band*: most differing bits, blocks to leave out by bits, by buckets."""
        while len(self.starts) <= band + 1:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        small = self.starts[band + 1] - 1
        both = small + small * self.den // self.num
        differ = both * (self.den - self.num) // (self.den + self.num)
        spare = -(-(differ + 1) // 10)
        return differ, spare, spare + 1


def _kept_blocks(shingles: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """Join keys of a set's blocks in the sketch of a band, without the blocks of the fewest bits.

    Pairs share ``1 + s1 + s2`` equal blocks.  Both leave out their own first ``s1`` in the order (bits,
    key); of the equal blocks the last ``1 + s2`` in that order have ``s1`` before them in either
    document, so both keep them.
    """
    differ, by_bits, by_buckets = bands.blocks(band)
    if not differ:
        return np.zeros(0, np.int64)  # only equal sets
    k = differ + 1 + by_bits + by_buckets
    spot = np.sort(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(k * BLOCK_BITS))
    edge = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
    odd = np.diff(np.append(edge, len(spot))) % 2 == 1
    bits = spot[edge][odd]
    block = (bits // np.uint64(BLOCK_BITS)).astype(np.int64)
    count = np.bincount(block, minlength=k)
    key = np.zeros(k, np.uint64)
    used = np.flatnonzero(count)
    if len(used):
        key[used] = np.bitwise_xor.reduceat(mix64(bits + np.uint64(1)), np.searchsorted(block, used))
    key = mix64(key ^ mix64(np.arange(k, dtype=np.uint64) + np.uint64((band << 32) + (1 << 20))))
    order = np.lexsort((key, count))
    return key[order[by_bits:]].view(np.int64)


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """``doc, n, s1, s2, sketch`` of every row: the size of its set, two sums that tell sets apart, and its whole sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                rows = [(_profile(s), _sketch(s)) for s in shingle_sets(data, offsets, words)]
                found = np.array([x for x, _ in rows], np.int64)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SKETCH_WORDS), pa.array(np.concatenate([x for _, x in rows])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(found[:, k]) for k in range(3)], sketch], ["doc", *SET, "sketch"])

    return docs.mapInArrow(work, "doc bigint, n bigint, s1 bigint, s2 bigint, sketch array<bigint>")


def _profile(s: np.ndarray) -> tuple[int, np.int64, np.int64]:
    if not len(s):
        return 0, np.int64(0), np.int64(0)
    return len(s), np.sum(mix64(s)).astype(np.int64), np.sum(mix64(s ^ np.uint64(0x2545F4914F6CDD1D))).astype(np.int64)


def _matched(rows: DataFrame, sets: DataFrame, total: int, how: str) -> DataFrame:
    """*rows* joined with *sets* (``n, s1, s2, rows`` and more) by set.

    Sets that a thousandth of all rows hold are at most a thousand: they are broadcast, so that no task
    gets all the rows of one set.
    """
    hot = F.broadcast(sets.where(F.col("rows") * 1000 >= total).drop("rows"))
    cold = sets.where(F.col("rows") * 1000 < total).drop("rows")
    return rows.join(hot, SET).unionByName(rows.join(hot, SET, "left_anti").join(cold.hint("merge"), SET, how))


def _heads(source: DataFrame, members: DataFrame, copies: DataFrame) -> DataFrame:
    """``doc, text`` of the rows that stand for their class.

    Rows without a part in any class of several *members* go straight through; only the others are
    shuffled, to leave out *copies* and repeated rows.
    """
    rows = source.where(F.col("doc").isNotNull() & (F.length("text") > 0))
    may = id_filter.maybe(members, "doc", F.col("doc"))
    maybe = rows.where(may).join(copies.select("doc").hint("merge"), "doc", "left_anti")
    once = maybe.groupBy("doc", F.xxhash64("text").alias("body")).agg(F.first("text").alias("text")).select("doc", "text")
    return rows.where(~may).unionByName(written(once, "heads"))


def _keys(heads: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``doc, tag, key``: the join keys of every set for the two bands it may pair in.

    *tag* is twice what the document may leave out in that band, plus the side: 0 where its set is the
    smaller of a pair, 1 where it is the larger.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                rows, tags, keys = [], [], []
                for row, s in enumerate(shingle_sets(data, offsets, words)):
                    band = bands.of(len(s)) if len(s) else -1
                    for side in (0, 1):
                        if band - side < 0:
                            continue
                        made = _kept_blocks(s, band - side, bands)
                        keys.append(made)
                        tags.append(2 * bands.blocks(band - side)[2] + side)
                        rows.append((row, len(made)))
                if not keys:
                    continue
                count = np.array([n for _, n in rows])
                doc = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.array([r for r, _ in rows]), count)))
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.repeat(np.array(tags, np.int32), count)), pa.array(np.concatenate(keys))], ["doc", "tag", "key"])

    return heads.mapInArrow(work, "doc bigint, tag int, key bigint")


def _buckets(keys: DataFrame) -> DataFrame:
    """``key, doc, degree`` of the keys that two classes or more share, without what the slack leaves out.

    *keys* has ``doc, tag, key``; *tag* is twice what that document may leave out in that band, plus the side.  Of those in large buckets it leaves out the largest first; the size of a bucket is the
    same for both documents of a pair, so of their ``1 + s2`` common keys the smallest stays in both.
    """
    dealt = keys.repartition("key")  # both uses below read this one exchange
    size = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("doc").alias("any_doc"), F.max("tag").alias("any_tag"))
    size = size.where((F.col("size") > 1) & F.col("any_doc").isNotNull() & F.col("any_tag").isNotNull()).select("key", "size")  # the same columns, so the same exchange
    shared = written(dealt.join(size.hint("shuffle_hash"), "key").select("key", "doc", "tag", "size"), "buckets")
    # A pair shares 1 + s2 keys, and so each of its documents has as many shared ones; those with fewer have no partner.
    held = F.count(F.lit(1)).over(Window.partitionBy("doc", "tag"))
    likely = written(shared.withColumn("held", held).where(F.col("held") > F.shiftright("tag", 1)).drop("held"), "likely-buckets")
    large = likely.where(F.col("size") > LARGE)
    rank = F.row_number().over(Window.partitionBy("doc", "tag").orderBy(F.desc("size"), "key"))
    stay = large.withColumn("rank", rank).where(F.col("rank") > F.shiftright("tag", 1)).select("key", "doc")
    kept = likely.where(F.col("size") <= LARGE).select("key", "doc").unionByName(stay)
    out = written(kept.withColumn("degree", F.count(F.lit(1)).over(Window.partitionBy("doc"))), "kept-buckets")
    del dealt, size, held, large, stay, kept
    discard(out.sparkSession, shared, likely)
    return out


def _sets_of(heads: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """``doc, shingles`` (sorted hashes as bytes) of the documents in *pairs* (``a, b``).

    A bitmap of their ids, of fixed size, lets the scan skip most other texts; rows that are not in a
    pair find no partner in the joins that follow.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, offsets, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["doc", "shingles"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    return heads.where(id_filter.maybe(ends, "doc", F.col("doc"))).mapInArrow(work, "doc bigint, shingles binary")


def _sketch(s: np.ndarray) -> np.ndarray:
    """The parity sketch of a whole set, as 64-bit words."""
    spot = (mix64(s ^ np.uint64(0x6C62272E07BB0142)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(spot, minlength=SKETCH_BITS) % 2 == 1).view(np.int64)


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose sets have ``den * intersection >= num * union``; only sets that a pair needs are shuffled."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    sets = sets.where(id_filter.maybe(ends, "doc", F.col("doc")))
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "x", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                if den * len(x) < num * len(y) or not len(x):
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                ok[i] = den * both >= num * (len(x) + len(y) - both)
            batch = batch.select(["a", "b"]).filter(pa.array(ok))
            yield batch

    return rows.mapInArrow(work, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of *docs*: ``doc_id, n_shingles, component_id``.

    Words are runs without white space, A-Z lower-cased; a text's set holds its distinct shingles of
    *words* words, or the whole sequence where it has fewer.  Texts link where ``den * intersection >=
    num * union``; ``component_id`` is the smallest id that links reach.  Texts without words (null,
    empty, white space) have no shingle and no link.  Rows of one id are one document: where their texts
    differ, it links by either text, and each row has its own ``n_shingles``.  Rows with a null id keep
    a null component and link nothing.  An empty table gives an empty table; other columns are left out,
    whatever their names.  Ids are integers.
    """
    source = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    facts = written(_profiles(source, words), "profiles")
    total = facts.count()
    real = facts.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = written(real.groupBy(*SET).agg(F.min("doc").alias("class"), F.count(F.lit(1)).alias("rows")), "classes")
    several = classes.where(F.col("rows") > 1)
    members = written(_matched(real, several, total, "inner").select("doc", "class"), "members")
    # Ids whose rows differ in their sets: they are no copies, and tie the classes of their sets together.
    one = F.struct(*SET)
    mixed = written(real.groupBy("doc").agg(F.min(one).alias("x"), F.max(one).alias("y")).where(F.col("x") != F.col("y")).select("doc"), "mixed")
    other = members.where(F.col("doc") != F.col("class"))
    heads = _heads(source, members, other.join(mixed, "doc", "left_anti"))
    joined = components(other.join(mixed, "doc", "left_semi").select(F.col("doc").alias("a"), F.col("class").alias("b")))
    buckets = _buckets(_keys(heads, words, num, den))
    sketches = written(real.select("doc", "n", "sketch").join(buckets.select("doc").distinct().hint("merge"), "doc", "left_semi").distinct(), "sketches")
    discard(docs.sparkSession)
    for round_ in range(2):
        # One member of each bucket is compared with the members of other groups: first the one that shares most keys, then any.
        named, head = _with_groups(buckets, joined, F.struct(-F.col("degree"), F.col("doc")) if round_ == 0 else F.xxhash64("doc"))
        pairs = named.join(head, "key").where(F.col("group") != F.col("head.group")).select("doc", F.col("head.doc").alias("other"))
        near = _near(pairs.groupBy("doc", "other").agg(F.count(F.lit(1)).alias("shared")), "doc", "other", sketches, num, den)
        best = near.groupBy("doc").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))
        pairs = written(best.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct(), "pairs")
        sets = written(_sets_of(heads, pairs, words), "sets")
        joined = _after(joined, pairs, sets, num, den)
        del named, head, near, best
        discard(docs.sparkSession, pairs, sets)
    open_ = _open_pairs(buckets, joined, sketches, num, den)
    sets = written(_sets_of(heads, open_, words), "sets")
    discard(docs.sparkSession, buckets, sketches)
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(TURNS[-1]))
    for first, stop in zip((0, *TURNS), TURNS):
        # A growing share of the pairs that still lie between groups: links among a few of them spare most of the rest.
        of = lambda end: joined.select(F.col("node").alias(end), F.col("component").alias(f"{end}_group"))
        apart = open_.where((turn >= first) & (turn < stop)).join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_group", "a") != F.coalesce("b_group", "b"))
        pairs = written(apart.select("a", "b"), "pairs")
        joined = _after(joined, pairs, sets, num, den)
        discard(docs.sparkSession, pairs)
    discard(docs.sparkSession, sets, open_)
    labels = classes.join(joined.withColumnRenamed("node", "class"), "class", "left").where((F.col("rows") > 1) | F.col("component").isNotNull()).select(*SET, "rows", F.coalesce("component", "class").alias("component"))
    found = _matched(real, labels, total, "left").unionByName(facts.where(F.col("doc").isNull() | (F.col("n") == 0)).withColumn("component", F.col("doc")))
    return found.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _after(joined: DataFrame, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The groups ``node, component`` after the links among *pairs* (``a, b``)."""
    if not pairs.head(1):
        return joined
    links = written(_linked(pairs, sets, num, den), "links")
    joined = merged(joined, links)
    discard(sets.sparkSession, links)
    return joined


def _near(pairs: DataFrame, a: str, b: str, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sketches differ in no more bits than those of linked sets can."""
    of = lambda end: sketches.select(F.col("doc").alias(end), F.col("n").alias(f"{end}_n"), F.col("sketch").alias(f"{end}_sketch"))
    bits = sum((F.bit_count(F.get(f"{a}_sketch", k).bitwiseXOR(F.get(f"{b}_sketch", k))) for k in range(1, SKETCH_WORDS)), F.bit_count(F.get(f"{a}_sketch", 0).bitwiseXOR(F.get(f"{b}_sketch", 0))))
    near = bits * (num + den) <= (F.col(f"{a}_n") + F.col(f"{b}_n")) * (den - num)
    return pairs.join(of(a).hint("merge"), a).join(of(b).hint("merge"), b).where(near).select(*pairs.columns)


def _with_groups(buckets: DataFrame, joined: DataFrame, first: Column) -> tuple[DataFrame, DataFrame]:
    """The members of buckets with their groups, and the first member of each bucket that holds several groups."""
    named = buckets.join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("group"), "degree")
    head = named.groupBy("key").agg(F.min_by(F.struct("doc", "group"), first).alias("head"), F.min("group").alias("g0"), F.max("group").alias("g1")).where(F.col("g0") != F.col("g1"))
    return named, head.select("key", "head")


def _open_pairs(buckets: DataFrame, joined: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: pairs of different groups in a bucket whose sketches differ in no more bits than linked sets can.

    Members outside the group of the bucket's head are paired with all members, so that a bucket in
    which one group is large costs its size times the number of the others.
    """
    named, head = _with_groups(buckets, joined, F.xxhash64("group", F.lit(7)))
    rows = named.join(head, "key").join(sketches, "doc").select("key", "doc", "group", (F.col("group") == F.col("head.group")).alias("main"), "n", *[F.get("sketch", k).alias(f"w{k}") for k in range(SKETCH_WORDS)])
    rows = written(rows, "open-members")
    x, y = rows.where(~F.col("main")).alias("x"), rows.alias("y")
    bits = sum((F.bit_count(F.col(f"x.w{k}").bitwiseXOR(F.col(f"y.w{k}"))) for k in range(1, SKETCH_WORDS)), F.bit_count(F.col("x.w0").bitwiseXOR(F.col("y.w0"))))
    once = F.col("y.main") | (F.col("x.doc") < F.col("y.doc"))
    near = bits * (num + den) <= (F.col("x.n") + F.col("y.n")) * (den - num)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.group") != F.col("y.group")) & once & near)
    return written(pairs.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct(), "open")
