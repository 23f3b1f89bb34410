"""Chroma audio fingerprints for media columns.

A recording (WAV bytes) becomes pitch-class frames.  Filters that compare
rectangles of the frames, summed with an integral image, are quantised to two
bits each and packed into one 32-bit integer per position.  Recordings are
aligned by histograms over all offsets: the differing bits at an offset say
whether it is a match, and the shared integers which match is the best.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import written

RATE = 4000
FRAME, HOP = 1024, 512
#: Frames under one filter.
WIDTH = 8


def _filters() -> list[tuple[int, int, int, int]]:
    """16 filters ``(kind, pitch class, height, width)``: from small to large, kinds in turn."""
    kinds = [0, 1, 2, 3]  # whole area, upper less lower, later less earlier, checkerboard
    return [(kinds[k % 4], (5 * k) % 12, 2 + 2 * (k // 6), 2 + 2 * (k % 4)) for k in range(16)]


FILTERS = _filters()


def decode(media: bytes) -> np.ndarray:
    """Mono samples of a 16-bit WAV at ``RATE``; other rates are resampled linearly.  Broken media: no samples."""
    try:
        with wave.open(io.BytesIO(media)) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0)
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float)
            x = x[: len(x) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(1)
            rate = w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0)
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)
    return x


_window = np.hanning(FRAME)
_freq = np.fft.rfftfreq(FRAME, 1 / RATE)
_used = np.flatnonzero((_freq >= 100) & (_freq <= 1900))
_class = np.mod(np.rint(12 * np.log2(_freq[_used] / 440.0)).astype(int), 12)
_fold = np.zeros((len(_used), 12))
_fold[np.arange(len(_used)), _class] = 1


def chroma(x: np.ndarray) -> np.ndarray:
    """Frames of 12 pitch-class energies, each of unit length."""
    n = (len(x) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    out = []
    for lo in range(0, n, 4096):
        at = np.arange(lo, min(n, lo + 4096))[:, None] * HOP + np.arange(FRAME)
        out.append(np.abs(np.fft.rfft(x[at] * _window, axis=1))[:, _used] ** 2 @ _fold)
    e = np.concatenate(out)
    return e / (np.sqrt((e * e).sum(1, keepdims=True)) + 1e-9)


def fingerprint(x: np.ndarray) -> np.ndarray:
    """One packed integer per position of the filters' window; none for recordings shorter than that."""
    e = chroma(x)
    n = len(e) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    e = np.concatenate([e, e], axis=1)  # pitch classes are a circle
    image = np.zeros((len(e) + 1, 25))
    image[1:, 1:] = e.cumsum(0).cumsum(1)

    def area(t: int, p: int, w: int, h: int) -> np.ndarray:
        return image[t + w : t + w + n, p + h] - image[t : t + n, p + h] - image[t + w : t + w + n, p] + image[t : t + n, p]

    code = np.zeros(n, np.uint32)
    for kind, p, h, w in FILTERS:
        if kind == 0:
            a, b = area(0, p, w, h), area(0, (p + 6) % 12, w, h)
        elif kind == 1:
            a, b = area(0, p + h // 2, w, h // 2), area(0, p, w, h // 2)
        elif kind == 2:
            a, b = area(w // 2, p, w // 2, h), area(0, p, w // 2, h)
        else:
            a = area(0, p, w // 2, h // 2) + area(w // 2, p + h // 2, w // 2, h // 2)
            b = area(w // 2, p, w // 2, h // 2) + area(0, p + h // 2, w // 2, h // 2)
        v = np.log1p(a) - np.log1p(b)
        level = (v > -0.25).astype(np.uint32) + (v > 0) + (v > 0.25)
        code = code << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)  # neighbours differ in one bit
    return code


def sonify(values: np.ndarray, note: int = 500) -> bytes:
    """A deterministic WAV of a vector: one note per value, two octaves over its range.  It stands in for a media column."""
    v = np.nan_to_num(np.asarray(values, float))
    top = np.abs(v).max() if len(v) else 0
    step = np.clip(((v / top if top else v) + 1) * 12, 0, 23).astype(int)
    phase = 2 * np.pi * np.cumsum(np.repeat(220 * 2 ** (step / 12), note)) / RATE
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((12000 * np.sin(phase)).astype("<i2").tobytes())
    return out.getvalue()


def sonified(rows: DataFrame, key: str, values: str) -> DataFrame:
    """``rec, media`` from a vector column; null vectors give null media."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                media = [None if v is None else sonify(np.array([np.nan if x is None else x for x in v])) for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["rec", "media"])

    return rows.select(F.col(key).cast("bigint").alias("rec"), F.col(values)).mapInArrow(work, "rec bigint, media binary")


def fingerprints(recordings: DataFrame) -> DataFrame:
    """``rec, n_items, codes array<int>`` of ``rec, media``; null, broken and short media have no code."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(decode(m.as_py())).view(np.int32) if m.is_valid else np.zeros(0, np.int32) for m in batch.column(1)]
            sizes = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(sizes).astype(np.int64)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["rec", "n_items", "codes"])

    return recordings.select("rec", "media").mapInArrow(work, "rec bigint, n_items bigint, codes array<int>")


def offsets_of(x: np.ndarray, rows: np.ndarray, sizes: np.ndarray, max_error: float, min_overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, offset, differing bits, overlap)`` of all offsets at which *x* matches rows of codes.

    *rows* is positions x rows, of *sizes* positions each; the rest of a column is padding.  At an offset
    position ``p`` of *x* meets position ``p + offset`` of the row.
    """
    m, (n, r) = len(x), rows.shape
    total = np.zeros((m + n - 1, r), np.uint16 if 32 * min(m, n) < 1 << 16 else np.uint32)
    held = None if (sizes == n).all() else (np.arange(n)[:, None] < sizes).astype(np.uint8)
    for i, code in enumerate(x):
        differ = np.bitwise_count(rows ^ code)
        if held is not None:
            differ *= held
        total[m - 1 - i : m - 1 - i + n] += differ
    offset = np.arange(1 - m, n)[:, None]
    overlap = np.minimum(m, sizes - offset) - np.maximum(0, -offset)
    at, row = np.nonzero((overlap >= min_overlap) & (total <= 32.0 * max_error * overlap))
    return row, offset[at, 0], total[at, row].astype(np.int64), overlap[at, row]


def _slices(codes: list[np.ndarray], limit: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, positions x rows, sizes)`` of recordings of like sizes, of about *limit* codes each."""
    sizes = np.array([len(c) for c in codes])
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * sizes[order[hi]] <= limit:
            hi += 1
        own = order[lo:hi]
        table = np.zeros((int(sizes[own[-1]]), len(own)), np.uint32)
        for c, k in enumerate(own):
            table[: sizes[k], c] = codes[k]
        yield own, table, sizes[own]
        lo = hi


def _aligner(shared, max_error: float, min_overlap: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(q, np.frombuffer(codes, np.uint32)) for q, codes in shared.value]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            codes = [np.array(v, np.int32).view(np.uint32) for v in batch.column(1).to_pylist()]
            for own, table, sizes in _slices(codes):
                out = []
                for q, x in asked:
                    best: dict[int, tuple] = {}
                    for c, offset, differ, overlap in zip(*(v.tolist() for v in offsets_of(x, table, sizes, max_error, min_overlap))):
                        lo = max(0, -offset)
                        votes = int(np.count_nonzero(x[lo : lo + overlap] == table[lo + offset : lo + offset + overlap, c]))
                        rank = (-votes, differ / (32.0 * overlap), abs(offset), offset)
                        if ids[own[c]] != q and (c not in best or rank < best[c][0]):
                            best[c] = (rank, (q, ids[own[c]], offset, votes, overlap, rank[1]))
                    out += [match for _, match in best.values()]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), kinds)], ["q", "class_id", "offset", "votes", "overlap", "bit_error"])

    return work


def _found(classes: DataFrame, max_error: float, min_overlap: int, block_bytes: int) -> DataFrame:
    """The matches of all classes with a query: these are sent to the tasks in blocks of bounded size."""
    spark = classes.sparkSession
    asked = classes.where("query").select("class_id", "codes")
    total = asked.agg(F.sum(4 * F.size("codes"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    spread = classes.select("class_id", "codes").repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "class_id")
    schema = "q bigint, class_id bigint, offset int, votes bigint, overlap int, bit_error double"
    out = spark.createDataFrame([], schema)
    for b in range(n):
        block = [(r["class_id"], np.array(r["codes"], np.int32).tobytes()) for r in asked.where(F.pmod(F.xxhash64("class_id"), F.lit(n)) == b).collect()]
        if block:
            out = out.unionByName(spread.mapInArrow(_aligner(spark.sparkContext.broadcast(block), max_error, min_overlap), schema))
    return out


def align(recordings: DataFrame, is_query: Column, max_error: float = 0.25, min_overlap: int = 8, block_bytes: int = 4 << 20) -> DataFrame:
    """Align the query recordings with all others.

    One row per row of *recordings* (``rec, media``): ``rec, n_items, codes_sha256, class_id`` (the least
    ``rec`` of equal fingerprints) and ``matches``: for the classes that hold a query, the other classes
    ``array<struct<class_id,offset,votes,overlap,bit_error>>`` that overlap at some offset by
    *min_overlap* positions or more with at most *max_error* of the bits differing; of several such
    offsets the one with most shared integers (``votes``), then the least error, then the least shift.
    Rows without codes have the hash of nothing, a null class and no match; rows with a null ``rec``
    have no class either.  Rows of one ``rec`` are rows like any others: each is in the class of its own
    codes.  Other columns are left out, whatever their names; an empty table gives an empty table; a very
    long recording is one row of work.  Every query is compared with every class at every offset, so that no match is
    lost and the work grows with queries times classes; equal recordings are one class, so that a common
    recording is compared once.
    """
    made = written(fingerprints(recordings).withColumn("query", F.coalesce(is_query, F.lit(False))).withColumn("codes_sha256", F.sha2(F.array_join(F.transform("codes", lambda c: c.cast("string")), " "), 256)), "fingerprints")
    named = made.where(F.col("rec").isNotNull() & (F.col("n_items") > 0))
    classes = written(named.groupBy("codes_sha256").agg(F.min("rec").alias("class_id"), F.max("query").alias("query"), F.first("codes").alias("codes")), "classes")
    match = F.struct("class_id", "offset", "votes", "overlap", F.round("bit_error", 6).alias("bit_error"))
    found = _found(classes, max_error, min_overlap, block_bytes).groupBy(F.col("q").alias("class_id")).agg(F.sort_array(F.collect_list(match)).alias("matches"))
    heads = classes.select("codes_sha256", "class_id").join(found, "class_id", "left")
    joined = made.select("rec", "n_items", "codes_sha256").join(heads, "codes_sha256", "left")
    no_class = F.col("rec").isNull() | (F.col("n_items") == 0)
    empty = F.array().cast("array<struct<class_id:bigint,offset:int,votes:bigint,overlap:int,bit_error:double>>")
    return joined.select("rec", "n_items", "codes_sha256", F.when(~no_class, F.col("class_id")).alias("class_id"), F.when(no_class, empty).otherwise(F.coalesce("matches", empty)).alias("matches"))


def digest(media: bytes) -> str:
    """The hash of a recording's integers, as in ``align``."""
    return hashlib.sha256(" ".join(str(c) for c in fingerprint(decode(media)).view(np.int32)).encode()).hexdigest()
