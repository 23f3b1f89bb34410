"""The trie of conversation prefixes, by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start with it, and
its owner is the smallest of them.  A conversation that owns a node owns all nodes below it on its path,
so that every conversation owns a suffix of its path, and nodes are known by the turns that own them:
no node is ever joined with another.  Windows over a prefix's turns mark the owned ones; then one
group-by of the prefixes sums, for each node, what its members say below it minus what they own there,
and how many of them own a leaf.

A prefix is known by two 64-bit sums (exclusive or) of hashes of (position, turn), so that running over
a conversation's turns gives all its prefixes, also where a conversation is cut into several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import hot_keys
from weftline.session import discard, written

KEY = ["depth", "p1", "p2"]
#: Bytes of joined ids that a task holds before it passes them on.
CHUNK = 1 << 20


# --- turns in order


def _starts(groups: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers starts."""
    return np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, bool)


def _since_start(running: np.ndarray, own: np.ndarray, starts: np.ndarray, undo) -> np.ndarray:
    """A running sum over all rows turned into one that begins anew at every start."""
    at = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
    return undo(running, undo(running, own)[at])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the number, exclusive ors and sum of their conversation's rows so far in it."""
    last, n, x1, x2, total = None, 0, np.int64(0), np.int64(0), np.int64(0)
    for batch in batches:
        if not batch.num_rows:
            continue
        c, h1, h2, chars = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("conv", "h1", "h2", "chars"))
        starts = _starts(c)
        ones = np.ones(len(c), np.int64)
        found = [
            _since_start(np.cumsum(ones), ones, starts, np.subtract),
            _since_start(np.bitwise_xor.accumulate(h1), h1, starts, np.bitwise_xor),
            _since_start(np.bitwise_xor.accumulate(h2), h2, starts, np.bitwise_xor),
            _since_start(np.cumsum(chars), chars, starts, np.subtract),
        ]
        if last is not None and c[0] == last:
            first = int(np.argmax(c != last)) if (c != last).any() else len(c)
            found[0][:first] += n
            found[1][:first] ^= x1
            found[2][:first] ^= x2
            found[3][:first] += total
        last, n, x1, x2, total = c[-1], *(f[-1] for f in found)
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=[*batch.schema.names, "n", "x1", "x2", "said"])


def run_over(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """*rows* (``conv, h1, h2, chars`` and others) with what their conversation has up to and with them.

    ``n`` rows, ``x1, x2`` exclusive ors of ``h1, h2``, and ``said``, the sum of ``chars``.  Range
    partitions cut a long conversation; each is run through on its own, and what a conversation has in
    the partitions before, of which there are at most two ends for each partition, is broadcast.
    """
    kinds = dict(rows.dtypes)
    dealt = rows.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order)
    sent = [c for c in rows.columns if c not in ("turn", "role", "text")]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in sent), "part int", "n bigint", "x1 bigint", "x2 bigint", "said bigint"])
    inside = written(dealt.select(*sent, F.spark_partition_id().alias("part")).mapInArrow(_scan, schema), name)
    ends = inside.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    outer = inside.join(F.broadcast(ends), "part").where(F.col("conv").isin(F.col("low"), F.col("high")))
    at_ends = outer.groupBy("conv", "part").agg(F.count("*").alias("n"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sum("chars").alias("said"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    had = at_ends.select("conv", "part", *[f(c).over(before).alias(f"{c}_before") for f, c in ((F.sum, "n"), (F.bit_xor, "x1"), (F.bit_xor, "x2"), (F.sum, "said"))]).where(F.col("n_before").isNotNull())
    had = F.broadcast(had)
    all_ = inside.join(had, ["conv", "part"], "left")
    add = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_before"), F.lit(0))
    xor = lambda c: F.col(c).bitwiseXOR(F.coalesce(F.col(f"{c}_before"), F.lit(0)))
    out = all_.select(*sent, add("n").alias("n"), xor("x1").alias("x1"), xor("x2").alias("x2"), add("said").alias("said"))
    out.written_path = inside.written_path
    return out


def own_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, pos, h1, h2, chars``: turns numbered from 0 by (turn, null first; role; text), hashed.

    Null roles and texts are empty; rows without a conversation are left out.
    """
    rows = rows.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    lane = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("bigint")
    rows = rows.select("conv", "turn", "role", "text", lane(1).alias("h1"), lane(16).alias("h2"), F.length("text").cast("bigint").alias("chars"))
    return run_over(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "trie-own").select("conv", (F.col("n") - 1).alias("pos"), "h1", "h2", "chars")


def spliced(own: DataFrame, total: int, every: int = 100, most: int = 6, share: int = hot_keys.SHARE) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % *every*, then c's own after its first h.

    h is the CRC-32 of the decimal c, modulo *most*.  Returns the turns and one row for each conversation
    with its number of turns, which may be none.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    base = F.col("conv") - F.col("conv") % every
    sizes = own.groupBy("conv").agg(F.count("*").alias("n"))
    # At most most - 1 turns of a conversation in every hundred.
    turn = F.struct("pos", "h1", "h2", "chars")
    heads = own.where((F.col("conv") == base) & (F.col("pos") < most - 1)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    convs = sizes.withColumns({"h": h, "base": base}).join(heads, "base", "left")
    head = F.filter(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), lambda t: t["pos"] < F.col("h"))
    convs = convs.select("conv", "n", "h", head.alias("head"), F.size(head).cast("bigint").alias("n_head"))
    convs = written(convs.withColumn("n_turns", F.col("n_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-convs")
    first = convs.select("conv", "n_turns", F.explode("head").alias("t")).select("conv", "n_turns", F.col("t.pos").alias("pos"), "t.h1", "t.h2", "t.chars")
    rest = hot_keys.join(own, convs.select("conv", "n", "h", "n_head", "n_turns"), ["conv"], total, share=share).where(F.col("pos") >= F.col("h"))
    turns = first.unionByName(rest.select("conv", "n_turns", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "h1", "h2", "chars"))
    return turns, convs


def occurrences(turns: DataFrame) -> DataFrame:
    """A row for each rebuilt turn: its conversation, its prefix (``depth, p1, p2``), and the code points ``before`` and with it."""
    at = turns.withColumns({"h1": F.xxhash64(F.lit(1), "pos", "h1", "h2"), "h2": F.xxhash64(F.lit(2), "pos", "h1", "h2")})
    run = run_over(at, [F.col("pos")], "trie-turns")
    out = run.select("conv", "n_turns", (F.col("pos") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), (F.col("said") - F.col("chars")).alias("before"), "said")
    out.written_path = run.written_path
    return out


# --- ownership


def owned(rows: DataFrame, total: int, share: int = hot_keys.SHARE) -> DataFrame:
    """The occurrences with their prefix's smallest member and whether any member goes on.

    Windows over the turns of a prefix; prefixes with a thousandth of all turns, at most a thousand, are
    counted instead and broadcast.
    """
    goes_on = F.col("depth") < F.col("n_turns")
    hot = written(rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv").alias("owner"), F.max(goes_on).alias("inner")).where(F.col("n") * share >= total).drop("n"), "trie-hot")
    same = Window.partitionBy(*KEY)
    cold = rows.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti")
    marked = cold.withColumns({"owner": F.min("conv").over(same), "inner": F.max(goes_on).over(same)})
    return rows.join(F.broadcast(hot), KEY).unionByName(marked)


def path_facts(marked: DataFrame) -> DataFrame:
    """For each conversation with turns: the depth from which on it owns its path, what is said before, and its end.

    ``from_depth`` is one beyond its path if it owns nothing; ``above`` owns the node above (null: the root).
    """
    mine = F.col("owner") == F.col("conv")
    last = F.col("depth") == F.col("n_turns")
    facts = marked.groupBy("conv").agg(
        F.count("*").alias("n"),
        F.min(F.when(mine, F.col("depth"))).alias("own_depth"),
        F.min(F.when(mine, F.col("before"))).alias("own_before"),
        F.max("said").alias("all_said"),
        F.max(F.when(~mine, F.struct("depth", "owner")))["owner"].alias("above"),
        F.max(F.when(mine & last & ~F.col("inner"), 1).otherwise(0)).alias("leaf"),
        F.max(F.when(last, F.struct(*KEY))).alias("end"),
    )
    return facts.select("conv", "n", F.coalesce("own_depth", F.col("n") + 1).alias("from_depth"), F.coalesce("own_before", "all_said").alias("shared"), "above", F.col("leaf").cast("bigint").alias("leaf"), *[F.col(f"end.{k}").alias(k) for k in KEY])


# --- digests of member lists


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a sorted partition: the digest of the joined ids, or, for its first and last run and for long ones, the ids in pieces."""
    names = [*KEY, "first", "ids", "ends_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    key, edge, held, size, first_run, out = None, True, [], 0, True, []

    def row(whole: bool):
        ids = ",".join(held)
        out.append((*key, int(held[0]), None if whole else ids, hashlib.sha256(ids.encode()).hexdigest() if whole else None))

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return made

    for b in batches:
        for *now, c in zip(*(b.column(k).to_pylist() for k in [*KEY, "conv"]), strict=True):
            if now != key:
                if key is not None:
                    row(not edge)
                    first_run = False
                key, edge, held, size = now, first_run, [], 0
            held.append(str(c))
            size += len(held[-1]) + 1
            if size >= CHUNK:
                row(False)
                edge, held, size = True, [], 0
                yield batch()
        if len(out) >= 1000:
            yield batch()
    if key is not None and held:
        row(False)
    if out:
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the pieces of each key, which come in order; a task holds one piece at a time."""
    key, state, out = None, None, []
    for b in batches:
        for *now, ids in zip(*(b.column(k).to_pylist() for k in [*KEY, "ids"]), strict=True):
            if now != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends_sha256``: the digest of the ids that end at each node, ascending, joined by commas.

    Ids are sorted by range partitions, whose inner runs are whole.  The runs at their ends are joined as
    texts of up to a megabyte and pass, piece by piece, through one digest each: the digest of a list
    can only be made in its order.
    """
    dealt = ends.select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    found = written(dealt.mapInArrow(_chunked, "depth bigint, p1 bigint, p2 bigint, first bigint, ids string, ends_sha256 string"), "trie-ends")
    pieces = found.where(F.col("ids").isNotNull()).select(*KEY, "first", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    made = pieces.select(*KEY, "ids").mapInArrow(_hashed, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")
    return found.where(F.col("ids").isNull()).select(*KEY, "ends_sha256").unionByName(made)


# --- the trie


def trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 100, most: int = 6, share: int = hot_keys.SHARE) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (``spliced``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null: the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes at or below it), ``saved_tokens`` (code points of the
    last turn times members less one, over the nodes at or below it), ``ends_sha256`` (of the ids of its
    members without a further turn).

    Turns are ordered by (*turn*, null first; *role*; *text*); a null role or text is empty; rows without
    a conversation are left out; repeated rows are turns of their own; a conversation without turns is a
    member of the root; without any conversation there is no node.  Other columns are ignored.

    Shuffles: the texts once, by (conversation, turn); then longs, three times the turns and twice the
    conversations.  A long conversation or a prefix that many share is not one task.
    """
    spark = rows.sparkSession
    own = own_turns(rows, conv, turn, role, text)
    own = written(own, "trie-numbered")
    total = own.count()
    turns, convs = spliced(own, total, every, most, share)
    at = written(occurrences(turns), "trie-occurrences")
    n_turns = at.count()
    marked = written(owned(at, n_turns, share), "trie-marked")
    facts = written(path_facts(marked), "trie-paths")
    # Below a node, a member's turns less those it owns: what it says from the node on up to where its own path begins.
    told = hot_keys.join(marked.select("conv", *KEY, "n_turns", "before", "said"), facts.select("conv", "n", "from_depth", "shared", "above", "leaf"), ["conv"], n_turns, share=share)
    root = convs.select("conv", "n_turns").join(facts.select("conv", "from_depth", "shared", "leaf"), "conv", "left").select(
        "conv", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("p1"), F.lit(0).cast("bigint").alias("p2"), "n_turns",
        F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("said"), F.coalesce("from_depth", F.lit(1)).alias("from_depth"), F.coalesce("shared", F.lit(0)).alias("shared"), F.lit(None).cast("bigint").alias("above"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    first = convs.agg(F.min("conv").alias("root")).first()["root"]
    is_root = F.col("depth") == 0
    owns = F.col("depth") >= F.col("from_depth")
    below = F.col("depth") < F.col("n_turns")
    parent = F.when(F.col("depth") > F.col("from_depth"), F.col("conv")).otherwise(F.coalesce("above", F.lit(first).cast("bigint")))
    nodes = told.unionByName(root).groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"),
        F.max(F.when(owns & ~is_root, parent)).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(F.when(below & (F.col("depth") + 1 >= F.col("from_depth")), 1).otherwise(0)).cast("bigint").alias("n_children"),
        F.sum("leaf").alias("leaves"),
        F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    ends = facts.select("conv", *KEY).unionByName(root.where(F.col("n_turns") == 0).select("conv", *KEY))
    out = nodes.join(end_digests(ends), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.when(is_root & (F.col("n_children") == 0), F.lit(1)).otherwise(F.col("leaves")).cast("bigint").alias("n_leaves"),
        F.col("saved_tokens").cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    discard(spark, own)
    return out
