"""Language-model scoring with a weighted backoff automaton.

Smoothed n-grams are states.  An arc (history, word) carries the smoothed
log-probability of a seen n-gram; a state's failure arc carries its backoff
weight and leads to the state of the history without its first word.  With
hierarchical Dirichlet smoothing

    p(w | h) = (c(h w) + m * p(w | h')) / (c(h) + m)

an arc exists where c(h w) > 0, and the failure weight of a state is
m / (c(h) + m); the unigrams are smoothed by adding one half.

No task holds the whole automaton.  Documents are dealt into blocks by a hash;
each block lists its distinct n-grams as sorted runs, one for each range of
hashes, the runs are added up, and every block gets back the counts of its own
n-grams: the part of the automaton that its texts can reach.  Runs are added up
by a tree: those of ``FANOUT`` blocks become the runs of one node, cut into as
many times more ranges, and so on up to one node.  So a task holds a bounded
number of runs, and their number grows with the input and not with its square.

A block's automaton is traversed once from left to right.  Its state after a
token depends on the last ``order - 1`` tokens at most, so that long texts are
cut into stretches which first read that many tokens before them; all stretches
of a block advance together, a token a step, and carry their state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.bytes_np import chunks, mix64, space_words
from weftline.session import written

#: The end token, and the history before the first word.
_END, _BEGIN = np.uint64(0x7E57AB1E5EED0001), np.uint64(0x7E57AB1E5EED0003)
_MULT = np.uint64(0xA24BAED4963EE407)
#: Nodes whose runs are added up together; a power of two.
FANOUT = 128
#: Tokens of a stretch.
STRETCH = 192


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens, each row ended by the end token, and the tokens per row."""
    words, per_row, _, _ = space_words(data, offsets)
    per = per_row + 1
    out = np.empty(len(words) + len(per), np.uint64)
    last = np.cumsum(per) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep] = words
    out[last] = _END
    return out, per


def gram_hashes(tokens: np.ndarray, per: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, the hash of the n-gram that ends at each token; histories start with one begin mark."""
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(per) - per] = True
    grams = [mix64(tokens)]
    whole = mix64(tokens)
    past = np.empty(len(tokens), np.uint64)
    for k in range(1, order):
        # The gram of order k+1 is the token after the gram of order k that ends just before it.
        past[0] = _BEGIN
        past[1:] = whole[:-1]
        past[first] = _BEGIN
        whole = mix64(past * _MULT + mix64(tokens) + np.uint64(k))
        grams.append(whole)
    return grams


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct hashes and their counts."""
    steps = np.diff(values, prepend=np.uint64(0))
    small = np.minimum(counts, 255).astype(np.uint8)
    big = counts[counts >= 255].astype(np.int64)
    # The steps of a run are of like size: their high bytes are equal and compress away.
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T) if len(steps) else np.zeros((8, 0), np.uint8)
    return len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + small.tobytes() + big.tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=17 * n + 64)
    planes = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n)
    values = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
    return values, _counts_from(raw[8 * n :], n)


def _counts_from(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    big = np.frombuffer(raw, np.int64, offset=n) if len(raw) > n else np.zeros(0, np.int64)
    counts[counts == 255] = big
    return counts


def _pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes())


def _unpack_counts(blob: bytes, n: int) -> np.ndarray:
    return _counts_from(zstandard.ZstdDecompressor().decompress(blob, max_output_size=9 * n + 64), n)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the first place of each, and which of them is at each place: by one sort.

    ``np.unique`` looks values up in a hash table, which takes several times as long where most are distinct.
    """
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(0, np.int64)
    sort = np.argsort(values)
    ranked = values[sort]
    new = np.append(True, ranked[1:] != ranked[:-1])
    edge = np.flatnonzero(new)
    which = np.empty(len(values), np.int64)
    which[sort] = np.cumsum(new) - 1
    return ranked[edge], np.minimum.reduceat(sort, edge), which


class _Grams:
    """The n-grams of one block of texts, order by order."""

    def __init__(self, texts: pa.Array, order: int, hash_bits: tuple[int, ...]):
        found = [token_hashes(data, offsets) for _, _, data, offsets in chunks(texts)]
        tokens = np.concatenate([t for t, _ in found]) if found else np.zeros(0, np.uint64)
        self.per = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int64)
        self.first = np.cumsum(self.per) - self.per
        self.hashes = [g >> np.uint64(64 - b) for g, b in zip(gram_hashes(tokens, self.per, order), hash_bits)] if len(tokens) else [np.zeros(0, np.uint64)] * order

    @cached_property
    def distinct(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``_distinct`` of each order."""
        return [_distinct(g) for g in self.hashes]


def _learnt(grams: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and how often the learnt rows hold them."""
    packed = np.sort(grams << np.uint64(1) | weight.astype(np.uint64))
    value = packed >> np.uint64(1)
    edge = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    return value[edge], np.add.reduceat((packed & np.uint64(1)).astype(np.int64), edge) if len(edge) else np.zeros(0, np.int64)


def _cut(values: np.ndarray, bits: int, range_bits: int) -> np.ndarray:
    """Where each of the ``2**range_bits`` ranges of sorted hashes of *bits* bits begins, and the end."""
    edges = np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(bits - range_bits)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


class Automaton:
    """States, arcs and failure arcs that a block's texts can reach.

    State 0 is the empty history.  A state of level k is a history of k tokens that training holds, or
    k begin marks.  *counts* has for each order the counts of the block's sorted distinct n-grams.
    """

    def __init__(self, grams: _Grams, counts: list[np.ndarray], n_train: int, n_vocab: int, opening: int, strength: tuple[float, ...]):
        order = len(counts)
        starts = np.zeros(int(grams.per.sum()), bool)
        starts[grams.first] = True
        at, own = [], []  # a place of each distinct n-gram; the n-gram at each place
        for _, place, inverse in grams.distinct:
            at.append(place)
            own.append(inverse)
        self.words, self.n_words = own[0], max(len(at[0]), 1)
        base = np.cumsum([1, *[len(at[k]) for k in range(order - 1)]])  # the first state of each level
        self.begin = np.where(opening > 0, base[-1] + np.arange(order - 1), 0) if order > 1 else np.zeros(0, np.int64)
        size = int(base[-1]) + order - 1
        self.fail, self.fail_weight = np.zeros(size, np.int64), np.zeros(size)
        chance = [(counts[0] + 0.5) / (n_train + 0.5 * (n_vocab + 1))]
        longest = []  # for each n-gram, the longest of its ends that is a state
        shorter = np.zeros(len(at[0]), np.int64)
        for k in range(order - 1):
            state = base[k] + np.arange(len(at[k]))
            self.fail[state] = shorter
            self.fail_weight[state] = np.log10(strength[k] / (counts[k] + strength[k]))
            self.fail[base[-1] + k] = self.begin[k - 1] if k else 0
            self.fail_weight[base[-1] + k] = np.log10(strength[k] / (opening + strength[k]))
            longest.append(np.where(counts[k] > 0, state, shorter))
            if k + 2 < order:
                shorter = longest[k][own[k][at[k + 1]]]
        self.root_target = longest[0] if order > 1 else np.zeros(len(at[0]), np.int64)
        keys, weights, targets = [], [], []
        for k in range(1, order):
            i = at[k]
            past = own[k - 1][np.maximum(i - 1, 0)]
            history = np.where(starts[i], self.begin[k - 1], base[k - 1] + past)
            held = np.where(starts[i], opening, counts[k - 1][past])
            lower = chance[k - 1][own[k - 1][i]]
            chance.append(np.where(held > 0, (counts[k] + strength[k - 1] * lower) / (held + strength[k - 1]), lower))
            arc = np.flatnonzero((held > 0) & (counts[k] > 0))
            keys.append(history[arc] * self.n_words + own[0][i[arc]])
            weights.append(np.log10(chance[k][arc]))
            targets.append(longest[k][arc] if k < order - 1 else longest[k - 1][own[k - 1][i[arc]]])
        sort = np.argsort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        pick = lambda parts, kind: np.concatenate(parts)[sort] if parts else np.zeros(0, kind)
        self.arc_key, self.arc_weight, self.arc_target = pick(keys, np.int64), pick(weights, float), pick(targets, np.int64)
        self.root_weight = np.log10(chance[0])
        self.start = int(self.begin[-1]) if order > 1 else 0
        self.order = order

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word, and its log-probabilities: along failure arcs until an arc has the word."""
        state, total, new = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        waiting = np.arange(len(state))
        while len(waiting):
            here = state[waiting]
            key = here * self.n_words + word[waiting]
            at = np.minimum(np.searchsorted(self.arc_key, key), max(len(self.arc_key) - 1, 0))
            hit = (self.arc_key[at] == key) & (here > 0) if len(self.arc_key) else np.zeros(len(key), bool)
            found, at = waiting[hit], at[hit]
            total[found] += self.arc_weight[at]
            new[found] = self.arc_target[at]
            root = waiting[here == 0]
            total[root] += self.root_weight[word[root]]
            new[root] = self.root_target[word[root]]
            waiting = waiting[~hit & (here > 0)]
            total[waiting] += self.fail_weight[state[waiting]]
            state[waiting] = self.fail[state[waiting]]
        return new, total

    def traverse(self, first: np.ndarray, per: np.ndarray) -> np.ndarray:
        """The log10 probability of each text, given its first token and their number."""
        parts = -(-per // STRETCH)
        text = np.repeat(np.arange(len(per)), parts)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = first[text] + turn * STRETCH
        size = np.minimum(STRETCH, first[text] + per[text] - begin)
        before = np.where(turn > 0, self.order - 1, 0)  # tokens that are read for the state alone
        begin, size = begin - before, size + before
        sort = np.argsort(-size, kind="stable")
        text, begin, size, before = text[sort], begin[sort], size[sort], before[sort]
        state = np.where(before > 0, 0, self.start)
        total = np.zeros(len(text))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))  # stretches longer than t
            state[:n], weight = self.step(state[:n], self.words[begin[:n] + t])
            total[:n] += np.where(before[:n] <= t, weight, 0.0)
        return np.bincount(text, total, len(per))


def score(
    docs: DataFrame,
    learn: Column,
    text: str = "text",
    order: int = 3,
    strength: tuple[float, ...] = (1000.0, 5.0),
    carry: list[str] | None = None,
    block_bytes: int = 10 << 20,
    hash_bits: tuple[int, ...] = (60, 46, 46),
    fanout: int = FANOUT,
) -> DataFrame:
    """Train on the rows that *learn* marks and score every whole text.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end.  Adds to the *carry*
    columns (default: all): ``n_tokens, n_known`` (tokens that training holds), ``train_tokens,
    base_score`` (add-one-half unigrams) and ``score``, both sums of log10 probabilities.  Null texts
    are empty and score their end token; a null *learn* is false.  Repeated rows count and are scored as
    often as they occur; columns of the results' names are replaced; an empty table gives an empty table.
    *strength* has ``m`` above for histories of one word, two words and so on; *hash_bits* identify an
    n-gram of each order: 60 keep words apart, fewer halve what longer n-grams shuffle, and of 10**9 of
    those about one in 10**5 then shares its count with another (give more bits for larger corpora).

    Shuffles: the texts once for the counts and once for the scores, a compressed run of distinct n-grams
    for each block and range, and their counts back.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in names]
    rows = docs.select(*[f"`{c}`" for c in carry], docs[text].cast("string").alias("__text"), F.coalesce(learn, F.lit(False)).alias("__learn"))
    size, opening = rows.agg(F.sum(F.octet_length("__text")), F.count_if("__learn")).first()
    n_blocks = max(1, -(-int(size or 0) // block_bytes))
    block = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in carry[:1]], F.col("__text")), F.lit(n_blocks))
    dealt = rows.withColumn("__block", block).repartition(n_blocks, "__block")
    n_carry = len(carry)
    range_bits = (max(1, min(n_blocks, fanout) // 2) - 1).bit_length()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            own = batch.column(2).to_numpy()
            for b in np.unique(own):
                parts.setdefault(int(b), []).append(batch.filter(pa.array(own == b)))
        for b in list(parts):
            table = pa.Table.from_batches(parts.pop(b))
            grams = _Grams(table.column(0).cast(pa.large_string()).combine_chunks(), order, hash_bits)
            weight = np.repeat(table.column(1).to_numpy(), grams.per)
            for k, g in enumerate(grams.hashes):
                yield _run_rows(b, k, *_learnt(g, weight), hash_bits[k], range_bits)

    runs = dealt.select("__text", "__learn", "__block").mapInArrow(listed, RUNS)
    answers, n_train, n_vocab = _summed(runs, n_blocks, range_bits, hash_bits, fanout)

    def traverse(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The texts of one block over its part of the automaton."""
        grams = _Grams(left.column(n_carry).cast(pa.large_string()).combine_chunks(), order, hash_bits)
        counts = _by_order(right, [values for values, _, _ in grams.distinct], hash_bits, range_bits)
        automaton = Automaton(grams, counts, n_train, n_vocab, opening, strength)
        sums = lambda x: np.add.reduceat(x[automaton.words], grams.first)
        out = [grams.per, sums((counts[0] > 0).astype(np.int64)), np.full(left.num_rows, n_train), sums(automaton.root_weight), automaton.traverse(grams.first, grams.per)]
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        return pa.table([*[left.column(i) for i in range(n_carry)], *[pa.array(x, kind) for x, kind in zip(out, kinds)]], names=[*carry, *names])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n_carry])
    schema = f"{kinds}n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    texts = dealt.select(*[f"`{c}`" for c in carry], "__text", "__block")
    return texts.groupBy("__block").cogroup(answers.withColumnRenamed("node", "__block").groupBy("__block")).applyInArrow(traverse, schema)


#: Runs: the sorted hashes of an order that a node holds in a range, with counts.  Answers have the counts of the whole corpus.
RUNS = "node bigint, range bigint, order int, run binary"


def _run_rows(node: int, order: int, values: np.ndarray, counts: np.ndarray, bits: int, range_bits: int, first: int = 0) -> pa.RecordBatch:
    """The run of one order, cut into ranges; *first* is the range that the first cut begins at."""
    bounds = _cut(values, bits, range_bits)
    held = np.flatnonzero(np.diff(bounds))
    blobs = [_pack(values[bounds[r] : bounds[r + 1]], counts[bounds[r] : bounds[r + 1]]) for r in held]
    return pa.RecordBatch.from_arrays([pa.array([node] * len(held), pa.int64()), pa.array(held + first, pa.int64()), pa.array([order] * len(held), pa.int32()), pa.array(blobs, pa.binary())], ["node", "range", "order", "run"])


def _by_order(answers: pa.Table, values: list[np.ndarray], hash_bits: tuple[int, ...], range_bits: int) -> list[np.ndarray]:
    """For each order, the answered counts of a node's sorted distinct hashes."""
    known = {(k, r): c for k, r, c in zip(answers.column("order").to_pylist(), answers.column("range").to_pylist(), answers.column("counts").to_pylist())}
    out = []
    for k, own in enumerate(values):
        bounds = _cut(own, hash_bits[k], range_bits)
        parts = [_unpack_counts(known[k, int(r)], int(bounds[r + 1] - bounds[r])) for r in np.flatnonzero(np.diff(bounds))]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return out


class _Merge:
    """The runs of one order that several nodes hold in one range, added up."""

    def __init__(self, blobs: list[bytes]):
        own = [_unpack(b) for b in blobs]
        self.sizes = [len(v) for v, _ in own]
        joined, counts = np.concatenate([v for v, _ in own]), np.concatenate([c for _, c in own])
        self.values, _, self.at = _distinct(joined)
        self.counts = np.bincount(self.at, counts, len(self.values)).astype(np.int64)

    def answers(self, counts: np.ndarray) -> list[bytes]:
        """Each run's counts, given those of the distinct hashes."""
        ends = np.cumsum(self.sizes)
        return [_pack_counts(counts[self.at[end - size : end]]) for size, end in zip(self.sizes, ends)]


def _merges(table: pa.Table) -> Iterator[tuple[int, list[int], _Merge]]:
    """The orders in a group of runs, the rows of each, and their merge."""
    order = table.column("order").to_numpy()
    for k in np.unique(order):
        at = np.flatnonzero(order == k)
        yield int(k), at.tolist(), _Merge(table.column("run").take(pa.array(at)).to_pylist())


ANSWERS = "node bigint, range bigint, order int, counts binary"


def _answer_rows(table: pa.Table, k: int, at: list[int], counts: list[bytes]) -> pa.Table:
    rows = pa.array(at)
    return pa.table({"node": table.column("node").take(rows), "range": table.column("range").take(rows), "order": pa.array([k] * len(at), pa.int32()), "counts": pa.array(counts, pa.binary())})


def _summed(runs: DataFrame, nodes: int, range_bits: int, hash_bits: tuple[int, ...], fanout: int) -> tuple[DataFrame, int, int]:
    """The answers to *runs* of so many nodes, and the tokens and words of all runs."""
    group, shift = F.floor(F.col("node") / F.lit(fanout)).cast("bigint"), fanout.bit_length() - 1
    empty = pa.table({"node": pa.array([], pa.int64()), "range": pa.array([], pa.int64()), "order": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
    if nodes <= fanout:

        def top(table: pa.Table) -> pa.Table:
            out = [empty]
            for k, at, merge in _merges(table):
                out.append(_answer_rows(table, k, at, merge.answers(merge.counts)))
                if k == 0:  # this range's tokens and vocabulary
                    sums = np.array([merge.counts.sum(), (merge.counts > 0).sum()], np.int64).tobytes()
                    out.append(pa.table({"node": pa.array([-1], pa.int64()), "range": table.column("range")[:1], "order": pa.array([-1], pa.int32()), "counts": pa.array([sums], pa.binary())}))
            return pa.concat_tables([t.select(empty.column_names) for t in out]).combine_chunks()

        made = written(runs.groupBy("range").applyInArrow(top, ANSWERS), "lm-counts")
        totals = np.zeros(2, np.int64)
        for r in made.where("node = -1").select("counts").toLocalIterator():
            totals += np.frombuffer(r["counts"], np.int64)
        return made.where("node >= 0"), int(totals[0]), int(totals[1])

    runs = written(runs.withColumn("group", group), "lm-runs")

    def merged(table: pa.Table) -> pa.Table:
        """The runs of one group of nodes in one range, as runs of one node in finer ranges."""
        node, r = table.column("group")[0].as_py(), table.column("range")[0].as_py()
        out = []
        for k, _, merge in _merges(table):
            # Within this range the next bits of the hash are the finer range.
            low = merge.values & np.uint64((1 << (hash_bits[k] - range_bits)) - 1)
            out.append(_run_rows(node, k, low, merge.counts, hash_bits[k] - range_bits, shift, r << shift))
        return pa.Table.from_batches(out)

    # Hashes keep only the bits below their range, so that runs of a node lie in one range of fewer bits.
    up = runs.groupBy("group", "range").applyInArrow(merged, RUNS)
    above, n_train, n_vocab = _summed(up, -(-nodes // fanout), shift, tuple(b - range_bits for b in hash_bits), fanout)

    def replied(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [empty]
        for k, at, merge in _merges(left):
            part = right.filter(pa.array(right.column("order").to_numpy() == k))
            sort = np.argsort(part.column("fine").to_numpy())
            low = merge.values & np.uint64((1 << (hash_bits[k] - range_bits)) - 1)
            sizes = np.diff(_cut(low, hash_bits[k] - range_bits, shift))
            blobs = part.column("counts").take(pa.array(sort)).to_pylist()
            counts = np.concatenate([_unpack_counts(b, int(n)) for b, n in zip(blobs, sizes[sizes > 0])])
            out.append(_answer_rows(left, k, at, merge.answers(counts)))
        return pa.concat_tables([t.select(empty.column_names) for t in out]).combine_chunks()

    down = above.select(F.col("node").alias("group"), F.floor(F.col("range") / F.lit(fanout)).cast("bigint").alias("range"), "order", F.col("range").alias("fine"), "counts")
    answers = runs.groupBy("group", "range").cogroup(down.groupBy("group", "range")).applyInArrow(replied, ANSWERS)
    return written(answers, "lm-counts"), n_train, n_vocab
