"""Benchmark decontamination: CGK embedding, repeated bit-sampling LSH over item-sized windows, exact edit verification.

Words are symbols.  The CGK random walk maps a word sequence to a longer one, in
which sequences of small edit distance differ at few places: at every step it
emits the word under the pointer, and a random bit of (step, word) says whether
the pointer moves on.  Two walks need about as many steps as the square of the
edits to meet again, so that items are cut into segments of a few words: of g
segments one has at most a g-th part of the item's edits.  A table of the LSH
samples a few places of a segment's walk; a window of a text and a segment that
agree at a table's places are a candidate, and tables are repeated, over several
walks, until the target recall is reached.  A walk only looks ahead, so one
walk from a word serves windows of every size.  Candidates are verified by the
edit distance between the whole item and the best stretch of words around.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bytes_np import IS_WORDISH, LOWER, chunks, mix64, row_of, span_hashes, spans

#: Bits of the tables of known words and signatures.
_KNOWN_BITS = 22
#: Windows that are walked, and candidates that are looked at, together.
_AT_ONCE = 1 << 17


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters and digits, A-Z lower-cased: hashes, words per row, starts, ends."""
    low = LOWER[data]
    starts, ends, per_row = spans(IS_WORDISH[low], offsets)
    return span_hashes(low, starts, ends), per_row, starts, ends


@dataclass(frozen=True)
class Plan:
    """Parameters of the search.

    ``share``: an item of n words is found where a stretch is within ``floor(share * n)`` word edits.
    ``segment``: most words of a segment.  ``walks`` CGK walks with ``tables`` samples of ``places`` each
    for every size of segments; ``reach``: steps that are sampled, as a multiple of the segment's words.
    """

    share: float = 0.2
    segment: int = 12
    walks: int = 4
    tables: int = 5
    places: int = 4
    reach: float = 1.6
    seed: int = 11


class Signatures:
    """Sorted signatures and, for each, the items with the first and last place of a segment that has it."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        hashes, item, place = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((place, item, hashes))
        hashes, item, place = hashes[order], item[order], place[order]
        begins = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        self.item, self.least = item[begins], place[begins]
        self.most = place[np.append(begins[1:], len(item)) - 1] if len(begins) else place
        self.keys, first = np.unique(hashes[begins], return_index=True)
        self.first = np.append(first, len(begins))
        self.known = np.zeros(1 << _KNOWN_BITS, bool)
        self.known[self.keys >> np.uint64(64 - _KNOWN_BITS)] = True


class Items:
    """The benchmark items of one block, ready for the search; its size is that of the block."""

    def __init__(self, ids: list[int], texts: list[str], plan: Plan):
        self.plan = plan
        data = pa.array(texts, pa.large_string())
        words = []
        for _, _, raw, offsets in chunks(data):
            h, per_row, _, _ = word_hashes(raw, offsets)
            words += np.split(h, np.cumsum(per_row)[:-1])
        kept = [k for k, w in enumerate(words) if len(w)]
        self.ids, self.words = [ids[k] for k in kept], [words[k] for k in kept]
        self.distinct = [frozenset(w.tolist()) for w in self.words]
        self.limit = [int(plan.share * len(w)) for w in self.words]
        self.known = np.zeros(1 << _KNOWN_BITS, bool)
        # Segments by size class: those of a class are walked over as many words, their first ones.
        classes = sorted({int(1.25**k) for k in range(40)})
        segments: dict[int, list[tuple[int, int]]] = {}
        self.edits: dict[int, int] = {}  # of a class, the most edits of a segment that must be found
        for k, w in enumerate(self.words):
            self.known[w >> np.uint64(64 - _KNOWN_BITS)] = True
            parts = -(-len(w) // plan.segment)
            bounds = np.arange(parts + 1) * len(w) // parts
            for at, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                size = max(c for c in classes if c <= stop - at)
                segments.setdefault(size, []).append((k, at))
                self.edits[size] = max(self.edits.get(size, 0), self.limit[k] // parts)
        self.sizes = sorted(segments)
        rng = np.random.default_rng(plan.seed)
        steps = max([plan.places, *[int(plan.reach * size) for size in self.sizes]])
        # The top bit of a well mixed hash times a random odd number: the random bit of (step, word).
        self.odd = rng.integers(1, 1 << 62, (plan.walks, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # For each size and walk, the tables that sample each step.
        self.samples: dict[tuple[int, int], list[list[int]]] = {}
        for size in self.sizes:
            for w in range(plan.walks):
                reach = max(plan.places if size >= plan.places else 1, int(plan.reach * size))
                steps_of: list[list[int]] = [[] for _ in range(reach)]
                for t in range(plan.tables):
                    for step in np.random.default_rng([plan.seed, size, w, t]).permutation(reach)[: plan.places]:
                        steps_of[int(step)].append(t)
                self.samples[size, w] = steps_of
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        first = np.cumsum([0, *[len(w) for w in self.words]])
        found = []
        for size in self.sizes:
            item, place = (np.array(x) for x in zip(*segments[size]))
            starts = first[item] + place
            found += [(sign, item, place) for sign in self.signatures(size, flat, starts, starts + size)]
        self.tables = Signatures(found)

    def signatures(self, size: int, words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[np.ndarray]:
        """For each walk and table, the hash of the sampled symbols of the walks over *size* words from *starts*; past them and past *stops* a blank."""
        padded = np.append(words, np.uint64(0))
        stops = np.minimum(stops, starts + size)
        for w in range(self.plan.walks):
            signs = [np.zeros(len(starts), np.uint64) for _ in range(self.plan.tables)]
            at = starts.copy()
            for step, tables in enumerate(self.samples[size, w]):
                symbol = padded[at]
                symbol[at >= stops] = 0
                for t in tables:
                    signs[t] += symbol
                    signs[t] *= np.uint64(0x9E3779B97F4A7C15)
                at += ((symbol * self.odd[w, step]) >> np.uint64(63)).astype(np.int64)
            for t, sign in enumerate(signs):
                yield mix64(sign + np.uint64((size << 16) + (w << 8) + t))


def edit_window(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least edits between *item* and any stretch of *words*: ``(edits, start, end)``; of equal ones the first that ends."""
    n = len(words)
    cost = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    at = np.arange(n + 1)
    for i, w in enumerate(item):
        diagonal = cost[:-1] + (words != w)
        down = cost[1:] + 1
        new = np.empty(n + 1, np.int64)
        new[0] = i + 1
        new[1:] = np.minimum(diagonal, down)
        came = np.empty(n + 1, np.int64)
        came[0] = 0
        came[1:] = np.where(diagonal <= down, origin[:-1], origin[1:])
        # Insertions run along the row: the least of new[j] + (k - j) over j <= k.
        base = new - at
        best = np.minimum.accumulate(base)
        first = np.maximum.accumulate(np.where(base == best, at, 0))
        cost, origin = best + at, came[first]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def _regions(items: Items, h: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Distinct ``(row, item, first word, end word)``, sorted: the words around each candidate that can hold its item."""
    rows = row_of(per_row)
    first = np.cumsum(per_row) - per_row
    stop = first + per_row
    unknown = np.concatenate([[0], np.cumsum(~items.known[h >> np.uint64(64 - _KNOWN_BITS)])])
    size_of, limit_of = np.array([len(w) for w in items.words], np.int64), np.array(items.limit, np.int64)
    found = [np.zeros((2, 0), np.int64)]  # (row, item, first word) as one number, and the end word
    tables, n_items, width = items.tables, len(items.words), len(h) + 1
    begin = np.arange(len(h))
    for size in items.sizes:
        # A window with more unknown words than a segment may have edits is none.
        end = np.minimum(begin + size, stop[rows])
        likely = begin[unknown[end] - unknown[begin] <= items.edits[size]]
        for lo_ in range(0, len(likely), _AT_ONCE):
            starts = likely[lo_ : lo_ + _AT_ONCE]
            for sign in items.signatures(size, h, starts, stop[rows[starts]]):
                at = np.flatnonzero(tables.known[sign >> np.uint64(64 - _KNOWN_BITS)])
                slot = np.minimum(np.searchsorted(tables.keys, sign[at]), len(tables.keys) - 1)
                hit = tables.keys[slot] == sign[at]
                at, slot = starts[at[hit]], slot[hit]
                count = tables.first[slot + 1] - tables.first[slot]
                part = np.cumsum(count) // _AT_ONCE
                for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
                    n = count[cut]
                    entry = np.repeat(tables.first[slot[cut]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    place, k = np.repeat(at[cut], n), tables.item[entry]
                    row = rows[place]
                    lo = np.maximum(first[row], place - tables.most[entry] - limit_of[k])
                    hi = np.minimum(stop[row], place - tables.least[entry] + size_of[k] + limit_of[k])
                    # Each word of the item that the region cannot have is an edit.
                    keep = hi - lo - (unknown[hi] - unknown[lo]) >= size_of[k] - limit_of[k]
                    found.append(np.stack([((row * n_items + k) * width + lo)[keep], hi[keep]]))
    key, hi = np.concatenate(found, axis=1)
    sort = np.argsort(key, kind="stable")
    key, hi = key[sort], hi[sort]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    key, hi = key[edge], np.maximum.reduceat(hi, edge) if len(edge) else hi
    own = key // width
    return np.stack([own // max(n_items, 1), own % max(n_items, 1), key % width, hi], 1)


def _search(items: Items, h: np.ndarray, per_row: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """``(row, item, edits, first word, end word)`` of every match: the best one for a row and item."""
    first = np.cumsum(per_row) - per_row
    joined: list[list[int]] = []
    for row, k, lo, hi in _regions(items, h, per_row).tolist():
        if len(items.distinct[k].difference(h[lo:hi].tolist())) > items.limit[k]:
            continue  # so many of its words are missing: each is an edit
        if joined and joined[-1][:2] == [row, k] and lo <= joined[-1][3]:
            joined[-1][3] = max(hi, joined[-1][3])
        else:
            joined.append([row, k, lo, hi])
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for row, k, lo, hi in joined:
        edits, a, b = edit_window(items.words[k], h[lo:hi])
        if edits <= items.limit[k]:
            own = (edits, lo + a - int(first[row]), lo + b - int(first[row]))
            if (row, k) not in found or own < found[row, k]:
                found[row, k] = own
    return [(row, items.ids[k], *own) for (row, k), own in sorted(found.items())]


def blocks_of(benchmark: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of about *block_bytes*: each block is a query set against all rows."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).distinct().orderBy("id", "text").collect()
        if got:
            yield [r["id"] for r in got], [r["text"] for r in got]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", plan: Plan = Plan(), block_bytes: int = 4 << 20) -> DataFrame:
    """Passages of benchmark items in documents: ``doc_id, item_id, edits, first_word, end_word``.

    One row for each document row and item that match, with the least edits (in words) and its stretch of
    words.  Null or wordless texts and items match nothing; an item with a null id is searched for like any
    other and has a null ``item_id``; repeated rows give repeated matches, repeated items count once; other
    columns of *docs* are left out, whatever their names; empty tables give an empty table.  Every match is
    exact; at the most edits allowed, at least nine tenths of the passages are found at every length of an
    item, and unchanged passages always are.  No shuffle: items are sent to the tasks in blocks of bounded
    size, and the documents are read once for each block.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, edits int, first_word int, end_word int"
    out = None
    for ids, texts in blocks_of(benchmark, item_key, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts, plan))
        part = source.mapInArrow(_finder(shared), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


_ready: dict[str, Items] = {}


def _items(name: str, shared) -> Items:
    """The items of a block, made once by each worker."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = Items(*shared.value)
    return _ready[name]


def _finder(shared):
    name = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(name, shared)
        for batch in batches:
            for lo, _, data, offsets in chunks(batch.column(1)):
                h, per_row, _, _ = word_hashes(data, offsets)
                got = _search(items, h, per_row)
                if got:
                    row, item, edits, a, b = zip(*got)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(row) + lo)), pa.array(item, pa.int64()), *[pa.array(x, pa.int32()) for x in (edits, a, b)]], ["doc_id", "item_id", "edits", "first_word", "end_word"])

    return work


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan(), block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of *docs* in which no benchmark item is found, with all their columns.

    Rows with a null, empty or wordless text stay, and so does a repeated row as often as it occurs; items
    with a null id count; an empty table stays empty, and an empty benchmark drops nothing.  One map for
    each block of items.
    """
    out = docs
    at = docs.columns.index(text)
    schema = docs.schema
    for ids, texts in blocks_of(benchmark, "item_id", "text", block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts, plan))
        out = out.mapInArrow(_keeper(shared, at), schema)
    return out


def _keeper(shared, at: int):
    name = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(name, shared)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, data, offsets in chunks(batch.column(at)):
                h, per_row, _, _ = word_hashes(data, offsets)
                keep[[lo + x[0] for x in _search(items, h, per_row)]] = False
            yield batch.filter(pa.array(keep))

    return work
