"""Toxic passages by maximum-scoring segment search.

Token scores are log-odds between toxic and clean training texts of words and
of their prefixes, shrunk by a Dirichlet prior: what the whole corpus holds.  A
linear scan finds every maximal segment of positive sum.  The best segment of a
clean text of n tokens exceeds s with a chance of 1 - exp(-scale * n * exp(-decay
* s)): decay and scale are those at which the best segments of clean training
texts are likeliest, each text scored by a model that was not learnt from it.  A
text's evidence is the sum of the logarithms of these chances over its
significant segments, turned to a probability by a logistic fit on the training
texts, scored in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import id_filter
from weftline.llm.bytes_np import IS_WORDISH, LOWER, SpanHasher, chunks, mix64, row_of, spans
from weftline.session import discard, written

#: Prefix lengths in bytes; 0 is the whole word.
PREFIXES = (4, 5, 6, 0)
#: Log-odds that a token must reach to count.
LEAST = 0.7
#: A passage is significant where clean texts have one like it with this chance at most.
SIGNIFICANT = 0.1
#: The share of clean texts, those of the best segments, that the extreme-value law is fitted to.
TAIL = 0.2
#: Histograms of scores and evidence have so many bins for a factor of e.
STEPS = 32


@dataclass
class ToxicityModel:
    """One score for each bucket of hashed words and prefixes; the size is set by *bits*, not by the data."""

    bits: int
    score: np.ndarray
    base: float  # score of a token without evidence, below 0
    decay: float  # of the extreme-value law: its exponent for a unit of score
    scale: float  # and the chance passages for a token at score 0
    intercept: float
    slope: float


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words (letters, digits): starts, ends, words per row, lower-case bytes."""
    low = LOWER[data]
    starts, ends, per_row = spans(IS_WORDISH[low], offsets)
    return starts, ends, per_row, low


def buckets(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each prefix length, the bucket of every word; words that are not longer than the prefix have bucket 0."""
    found, hashes = [], SpanHasher(low)
    for k, size in enumerate(PREFIXES):
        stop = np.minimum(ends, starts + size) if size else ends
        h = mix64(hashes(starts, stop) + np.uint64(k)) >> np.uint64(64 - bits)
        if size:
            h[ends - starts <= size] = 0
        found.append(np.maximum(h, 1).astype(np.int64) * (h > 0) if size else np.maximum(h, 1).astype(np.int64))
    return found


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, sum)`` of a sequence, in linear time.

    Segments are disjoint; each has a positive sum, and no longer or shorter segment around it scores more.
    """
    if not len(values) or values.max() <= 0:
        return []
    total = np.concatenate([[0.0], np.cumsum(values)])
    kept: list[list] = []  # start, end, sum before it, sum with it
    for i in np.flatnonzero(values > 0):
        item = [int(i), int(i) + 1, total[i], total[i + 1]]
        while True:
            k = len(kept) - 1
            while k >= 0 and kept[k][2] >= item[2]:
                k = kept[k][4] if len(kept[k]) > 4 else k - 1
            if k < 0 or kept[k][3] >= item[3]:
                item.append(k)
                kept.append(item)
                break
            item = [kept[k][0], item[1], kept[k][2], item[3]]
            del kept[k:]
    return [(a, b, float(after - before)) for a, b, before, after, _ in kept]


def _held(counts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Texts that hold a bucket, but no more than its distinct neighbourhoods, as far as 64 bits tell them apart.

    A passage that many texts copy has the same neighbours everywhere, and so counts as one or a few.
    """
    empty = 64 - np.bitwise_count(bits).astype(float)
    return np.where(empty < 2, counts, np.minimum(counts, -64 * np.log(np.maximum(empty, 1) / 64)))


def _fold_counts(rows: DataFrame, bits: int) -> list[tuple[np.ndarray, np.ndarray, tuple[float, float]]]:
    """Texts of each class that hold each bucket, of rows ``(text, toxic, half)``: of either half and of both.

    Counted in the tasks, then added up by bucket.
    """
    cells = ("c0", "t0", "c1", "t1")  # clean and toxic texts of either half

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, 1 << bits), np.int32)
        around = np.zeros((4, 1 << bits), np.uint64)
        texts = np.zeros(4, np.int64)
        for batch in batches:
            cell = np.asarray(batch.column(1).to_pylist(), bool) + 2 * np.asarray(batch.column(2).to_pylist(), bool)
            for lo, hi, data, offsets in chunks(batch.column(0)):
                starts, ends, per_row, low = tokens(data, offsets)
                rows_ = row_of(per_row)
                words = SpanHasher(low)(starts, ends)
                sides = np.zeros(len(words), np.uint64)  # the words beside each word
                same = rows_[1:] == rows_[:-1]  # rows have no neighbours in other rows
                sides[1:] += words[:-1] * same
                sides[:-1] += mix64(words[1:]) * same
                bit = np.uint64(1) << (mix64(sides) >> np.uint64(58))
                cls = cell[lo:hi].astype(np.int64)
                texts += np.bincount(cls, minlength=4)
                for b in buckets(low, starts, ends, bits):
                    use = b > 0
                    seen = np.unique(rows_[use] << bits | b[use])
                    for k in np.unique(cls):
                        np.add.at(total[k], seen[cls[seen >> bits] == k] & ((1 << bits) - 1), 1)
                        own = use & (cls[rows_] == k)
                        np.bitwise_or.at(around[k], b[own], bit[own])
        total[:, 0] = texts
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(x[at], pa.int64()) for x in total], *[pa.array(x[at].view(np.int64)) for x in around]], ["bucket", *cells, *(f"near_{c}" for c in cells)])

    made = rows.mapInArrow(count, ", ".join(["bucket int", *(f"{c} bigint" for c in cells), *(f"near_{c} bigint" for c in cells)]))
    got = made.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cells], *[F.bit_or(f"near_{c}").alias(f"near_{c}") for c in cells]).toArrow()
    at = got.column("bucket").to_numpy()
    first = at == 0
    counts = [got.column(c).to_numpy().astype(float) for c in cells]
    near = [got.column(f"near_{c}").to_numpy().view(np.uint64) for c in cells]

    def of(parts: list[int]) -> tuple[np.ndarray, float]:
        held = np.zeros(1 << bits)
        n = sum(counts[k] for k in parts)
        held[at] = _held(n, np.bitwise_or.reduce([near[k] for k in parts]))
        held[0] = 0
        return held, float(n[first].sum())

    out = []
    for halves in ([0], [1], [0, 1]):
        (clean, n_clean), (toxic, n_toxic) = of([2 * h for h in halves]), of([2 * h + 1 for h in halves])
        out.append((clean, toxic, (n_clean, n_toxic)))
    return out


def _counts(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """Texts of each class that hold each bucket, of rows ``(text, toxic)``."""
    return _fold_counts(rows.withColumn("__half", F.lit(False)), bits)[2]


def _log_odds(clean: np.ndarray, toxic: np.ndarray, n: tuple[float, float], prior: float) -> np.ndarray:
    """Log-odds with a Dirichlet prior in proportion to the corpus, less 2.1 standard deviations towards 0; under LEAST none."""
    rate = (clean + toxic + 0.5) / (n[0] + n[1] + 1)
    a, b = toxic + prior * rate, clean + prior * rate
    delta = np.log(a / (n[1] + prior)) - np.log(b / (n[0] + prior))
    deviation = np.sqrt(1 / a + 1 / b)
    shrunk = np.abs(delta) - 2.1 * np.minimum(deviation, 4.0)
    return np.where(shrunk >= LEAST, np.sign(delta) * shrunk, 0.0)


def token_scores(model: ToxicityModel, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """The strongest of a word's own score and its prefixes' scores, or the base; a word right after itself in its row has the base."""
    best = np.full(len(starts), -np.inf)
    for b in buckets(low, starts, ends, model.bits):
        np.maximum(best, model.score[b], out=best)
    rows = row_of(per_row)
    best[1:][(b[1:] == b[:-1]) & (rows[1:] == rows[:-1])] = 0
    return np.where(best > 0, best, model.base)


def _passages(model: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Tokens of each row, and its maximal segments as bytes ``(start, end, sum)``."""
    starts, ends, per_row, low = tokens(data, offsets)
    values = token_scores(model, low, starts, ends, per_row)
    n = len(per_row)
    found: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
    first = np.cumsum(per_row) - per_row
    hits = np.add.reduceat(np.append(values > 0, False).astype(np.int64), np.minimum(first, len(values))) * (per_row > 0) if n else []
    for i in np.flatnonzero(hits):
        lo, hi = first[i], first[i] + per_row[i]
        found[i] = [(int(starts[lo + a] - offsets[i]), int(ends[lo + b - 1] - offsets[i]), s) for a, b, s in segments(values[lo:hi])]
    return per_row, found


def _surprise(model: ToxicityModel, s: float, n: int) -> float:
    """Less the logarithm of the chance that a clean text of *n* tokens has a segment of *s* or more."""
    expected = math.log(model.scale * n) - model.decay * s
    return -expected if expected < -30 else -math.log(-math.expm1(-math.exp(min(expected, 6.0))))


def evidence(model: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """For each row the calibrated evidence, and its significant passages as bytes ``(start, end, surprise)``."""
    per_row, rows = _passages(model, data, offsets)
    found = []
    for n, row in zip(per_row.tolist(), rows):
        told = [(a, b, _surprise(model, s, n)) for a, b, s in row]
        found.append([x for x in told if x[2] >= -math.log(SIGNIFICANT)])
    return np.array([sum(x for _, _, x in row) for row in found], float), found


def _best(model: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row's best segment, 0 without any."""
    return np.array([max((s for _, _, s in row), default=0.0) for row in _passages(model, data, offsets)[1]], float)


def _decay(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(x * s)) = 1, for scores with a negative mean: the exponent of the law."""
    p = weights / weights.sum()
    lo, hi = 1e-6, 1.0
    while (p * np.exp(np.minimum(hi * values, 600))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * values, 600))).sum() < 1 else (lo, mid)
    return hi


def _scored(clean: np.ndarray, toxic: np.ndarray, n: tuple[float, float], bits: int, prior: float) -> ToxicityModel:
    """A model with the token scores and the decay that follows from them, if tokens were independent."""
    score = np.maximum(_log_odds(clean, toxic, n, prior), 0).astype(np.float32)
    # Under clean text a token has its bucket's score as often as clean texts hold it, else the base.
    positive = score > 0
    share = np.minimum(clean[positive] / max(clean.sum(), 1), 1)
    values = np.append(score[positive], -1.0)
    weights = np.append(share, max(1 - share.sum(), 0.5)) + 1e-9
    return ToxicityModel(bits, score, -1.0, _decay(values.astype(float), weights), 1.0, -3.0, 1.0)


def _told(halves: list[ToxicityModel], rows: DataFrame, of) -> DataFrame:
    """``x, n, toxic`` of each distinct labelled text: a number by the other half's model, in steps of its logarithm, and its tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(halves)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in (False, True):
                own = batch.filter(pc.equal(batch.column(2), half))
                for lo, hi, data, offsets in chunks(own.column(0)):
                    x, n = of(shared.value[not half], data, offsets), tokens(data, offsets)[2]
                    yield pa.RecordBatch.from_arrays([pa.array(np.round(np.log1p(x) * STEPS).astype(np.int32)), pa.array(n.astype(np.int64)), *[own.column(k).slice(lo, hi - lo) for k in (1, 3)]], ["x", "n", "toxic", "body"])

    told = rows.select("__text", "__toxic", "__half", F.xxhash64("__text")).mapInArrow(look, "x int, n bigint, toxic boolean, body bigint")
    return told.groupBy("body", "toxic").agg(F.first("x").alias("x"), F.first("n").alias("n"))


def fit_law(best: np.ndarray, rows: np.ndarray, sizes: np.ndarray, decay: float, tail: float = TAIL) -> tuple[float, float]:
    """Decay and scale at which the best segments of clean texts are likeliest.

    *best* has sums of best segments, ascending, *rows* and *sizes* the texts with each and their tokens.
    The law is one of the tail: texts below the best sum that the share *tail* of them exceeds count as
    not beyond it.  *decay* is the one expected; it weighs as much as one text, and stands where no text
    has a segment beyond the limit.
    """
    above = np.cumsum(rows[::-1])[::-1]
    at = int(np.argmax(above <= max(tail * rows.sum(), 1))) if above[-1] <= max(tail * rows.sum(), 1) else len(best) - 1
    limit = best[at - 1] if at else 0.0
    s, c, n, rest = best[at:], rows[at:], sizes[at:], sizes[:at].sum()
    use = s > 0
    s, c, n, rest = s[use], c[use], n[use], rest + n[~use].sum()

    def reach(x: float) -> float:
        return float((n * np.exp(-x * (s - limit))).sum() + rest)

    def likely(x: float) -> float:
        return c.sum() * (math.log(x) - math.log(reach(x))) - x * float((c * (s - limit)).sum()) - math.log(x / decay) ** 2 / 2

    lo, hi = math.log(decay) - 5, math.log(decay) + 3
    for _ in range(4):  # the likelihood has one peak; a grid finds it and is narrowed
        grid = np.linspace(lo, hi, 65)
        k = int(np.argmax([likely(math.exp(g)) for g in grid]))
        lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, 64)]
    found = math.exp((lo + hi) / 2)
    return found, (float(c.sum()) + 1) / (reach(found) + 1) * math.exp(found * limit)


def _law(halves: list[ToxicityModel], clean: DataFrame) -> tuple[float, float]:
    got = sorted(_told(halves, clean, _best).groupBy("x").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect())
    decay = math.sqrt(halves[0].decay * halves[1].decay)
    if not got:
        return decay, 1.0
    x, rows, n = (np.array([r[k] for r in got], float) for k in ("x", "rows", "n"))
    return fit_law(np.expm1(x / STEPS), rows, n, decay)


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "toxic", bits: int = 20, prior: float = 20.0) -> ToxicityModel:
    """Learn from all labelled rows that *learn* allows; only bucket counts and histograms reach the driver.

    Rows without a text or with a null label count nothing; empty texts count as texts without words.  A key
    with several labels has the largest; repeated rows of *docs* count as often as they occur, but a passage
    that many texts copy counts as one or a few (see ``_held``).  Where one of the labels is missing, as in an
    empty table, no text has evidence.
    """
    marks = labels.where(learn & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("__toxic")).where(F.col("__toxic").isin(0, 1))
    marks = marks.select(F.col(key).alias("__key"), F.col("__toxic").cast("boolean").alias("__toxic"))
    texts = docs.where(learn & F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    likely = texts.where(id_filter.maybe(marks, "__key", F.col("__key")))
    joined = likely.join(marks.hint("merge"), "__key").select("__text", "__toxic", (F.pmod(F.xxhash64("__text"), F.lit(2)) == 0).alias("__half"))
    rows = written(joined, "labelled")
    counted = _fold_counts(rows.select("__text", "__toxic", "__half"), bits)
    if not min(counted[2][2]):
        discard(docs.sparkSession, rows)
        return ToxicityModel(bits, np.zeros(1 << bits, np.float32), -1.0, 1.0, 1.0, -3.0, 1.0)
    # A half counts twice, so that its scores are shrunk as little as those of all texts.
    halves = [_scored(2 * clean, 2 * toxic, (2 * n[0], 2 * n[1]), bits, prior) for clean, toxic, n in counted[:2]]
    model = _scored(*counted[2], bits, prior)
    # Law and logistic fit see every text as a new one is seen: scored by the half that it is not in.
    model.decay, model.scale = _law(halves, rows.where(~F.col("__toxic")))
    for half in halves:
        half.decay, half.scale = model.decay, model.scale
    got = _told(halves, rows, lambda m, data, offsets: evidence(m, data, offsets)[0]).groupBy("x", F.col("toxic").cast("int").alias("toxic")).count().collect()
    discard(docs.sparkSession, rows)
    x, y, w = (np.array([r[c] for r in got], float) for c in ("x", "toxic", "count"))
    x = np.expm1(x / STEPS)
    z = np.log1p(x)
    a, b = -3.0, 1.0
    for _ in range(100):  # Newton steps of a logistic fit with a weak prior
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        g = np.array([(w * (y - p)).sum() - 0.01 * (a + 3), (w * (y - p) * z).sum() - 0.01 * (b - 1)])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 0.01, (v * z).sum()], [(v * z).sum(), (v * z * z).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.intercept, model.slope = float(a), float(b)
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", carry: list[str] | None = None, passages: bool = True) -> DataFrame:
    """Score every whole text: ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and, with *passages*, the toxic passages.

    Passages are ``array<struct<start:int,end:int,surprise:double>>`` in bytes of the UTF-8 text.  Null
    and empty texts have no passage and the score of a text without evidence.  Columns of the results'
    names are replaced; an empty table gives an empty table.  One map over the table, no shuffle.
    """
    names = ["score", "predicted", *(["passages"] if passages else [])]
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in names]
    source = docs.select(*[f"`{c}`" for c in carry], docs[text].cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            total, found = [], []
            for _, _, data, offsets in chunks(batch.column(len(carry))):
                x, spans_ = evidence(m, data, offsets)
                total.append(x)
                if passages:
                    found += [[{"start": a, "end": b, "surprise": s} for a, b, s in row] for row in spans_]
            x = np.concatenate(total) if total else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(m.intercept + m.slope * np.log1p(x), -30, 30)))
            out = [*batch.columns[: len(carry)], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]
            if passages:
                out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(out, [*carry, *names])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(work, f"{kept}score double, predicted int" + (", passages array<struct<start:int,end:int,surprise:double>>" if passages else ""))
