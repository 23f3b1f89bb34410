"""Held-out mining of n-gram macros in symbol sequences, and comparison of two snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import hash_fold, percent_growth
from weftline.session import written

# A pattern must hold a symbol with one of these in it; costs in bytes.
INFORMATIVE = ["ADD", "SUB", "MUL", "DIV", "REM", "FIELD", "INVOKE", "ARRAY", "CAST", "INSTANCEOF", "NEWARRAY", "COMPARE"]
REFERENCE_BYTES, CLASS_BYTES = 3, 8
#: A packed pattern: between its symbols, and before what stands for either sign or for a null.
_JOINT, _ESCAPE = "\x1f", "\x1e"
#: Rows of a batch of counted patterns.
OUT_ROWS = 20_000


def occurrences(rows: DataFrame, key: list[str], symbols: str = "opcodes", sizes: str = "sizes", lengths: range = range(4, 9), informative: list[str] | None = INFORMATIVE) -> DataFrame:
    """``key..., pattern, bytes`` of every kept occurrence: greedy from the left, none overlaps its own pattern in a row.

    Patterns of all lengths stand on their own.  A row is cut into its n-grams, with their bytes, before it
    is spread, so that no spread row carries the sequence.  An occurrence whose pattern was last seen a whole
    length before is always kept; only runs of occurrences that overlap are folded, each on its own.
    """
    n = F.size(symbols)
    starts = lambda k: F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    total = lambda i, k: F.aggregate(F.slice(sizes, i + 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    cut = lambda k: F.transform(starts(k), lambda i: F.struct(F.slice(symbols, i + 1, k).alias("pattern"), i.alias("at"), total(i, k).alias("bytes")))
    grams = F.flatten(F.array(*[cut(k) for k in lengths]))
    if informative is not None:
        grams = F.filter(grams, lambda g: F.exists(g["pattern"], lambda s: _any(s, informative)))
    part = rows.select(*key, F.explode(grams).alias("g")).select(*key, "g.*").withColumn("length", F.size("pattern"))
    seen = Window.partitionBy(*key, "pattern").orderBy("at")
    alone = F.coalesce(F.col("at") - F.lag("at").over(seen) >= F.col("length"), F.lit(True))
    runs = part.withColumn("alone", alone).withColumn("run", F.sum(F.col("alone").cast("int")).over(seen))
    grouped = runs.groupBy(*key, "pattern", "length", "run").agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("found"))
    empty = F.struct(F.lit(0).alias("free"), F.array().cast("array<bigint>").alias("kept"))
    pick = F.aggregate("found", empty, lambda a, x: F.when(x["at"] >= a["free"], F.struct((x["at"] + F.col("length")).alias("free"), F.concat(a["kept"], F.array(x["bytes"])).alias("kept"))).otherwise(a))
    return grouped.select(*key, "pattern", F.explode(pick["kept"]).alias("bytes"))


def pattern_counts(rows: DataFrame, by: list[str], symbols: str = "opcodes", sizes: str = "sizes", lengths: range = range(4, 9), informative: list[str] | None = INFORMATIVE) -> DataFrame:
    """``by..., pattern, n, bytes, rows``: the kept occurrences of ``occurrences`` with their bytes, and the rows that hold them.

    A task cuts and folds a batch of sequences at once and adds up the patterns of each group in it, so that only
    counts are shuffled.  Patterns are packed texts (``unpacked`` gives the array).  Missing sizes count as none.
    """
    packed = F.transform(symbols, lambda s: F.coalesce(F.replace(F.replace(s, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_JOINT), F.lit(_ESCAPE + "s")), F.lit(_ESCAPE + "n")))
    told = F.transform(symbols, lambda s: F.lit(True) if informative is None else F.coalesce(_any(s, informative), F.lit(False)))
    weights = F.transform(symbols, lambda s, i: F.coalesce(F.get(sizes, i).cast("bigint"), F.lit(0).cast("bigint")))
    ready = rows.where(F.size(symbols) >= min(lengths)).select(*by, packed.alias("__symbols"), weights.alias("__sizes"), told.alias("__told"))
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*by).schema.fields] + ["pattern string, n bigint, bytes bigint, rows bigint"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in lengths:
                made = _counted(batch, by, k)
                for at in range(0, len(made), OUT_ROWS):
                    yield made.slice(at, OUT_ROWS)

    return ready.mapInArrow(work, kind).groupBy(*by, "pattern").agg(*[F.sum(c).alias(c) for c in ("n", "bytes", "rows")])


def unpacked(pattern: str) -> Column:
    """The symbols of a packed pattern."""
    plain = lambda s: F.replace(F.replace(s, F.lit(_ESCAPE + "s"), F.lit(_JOINT)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))
    return F.transform(F.split(pattern, _JOINT, -1), lambda s: F.when(s != _ESCAPE + "n", plain(s)))


def _counted(batch: pa.RecordBatch, by: list[str], k: int) -> pa.RecordBatch:
    """The counted patterns of *k* symbols of a batch of sequences."""
    lists = batch.column(batch.schema.get_field_index("__symbols"))
    flat = lists.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    row = np.repeat(np.arange(len(lists)), np.diff(ends, prepend=0))
    total = lambda name: np.concatenate([[0], np.cumsum(batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
    size, told = total("__sizes"), total("__told")
    at = np.arange(len(row))
    at = at[at + k <= ends[row]]
    at = at[told[at + k] > told[at]]
    # Grams are numbered exactly, one symbol more at a time.
    codes = flat.indices.to_numpy().astype(np.int64)
    gram = codes[at]
    for j in range(1, k):
        gram = np.unique(gram * len(flat.dictionary) + codes[at + j], return_inverse=True)[1]
    key = np.unique(row[at] * (len(at) + 1) + gram, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    if len(at) == 0:
        kept = np.zeros(0, bool)
    else:
        place = key * (2 * len(row)) + at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        # Always kept: the first of a pattern in a row, and one whose pattern was last seen a whole length before.
        kept = new | np.concatenate([[True], at[1:] - at[:-1] >= k])
        front = np.flatnonzero(kept)
        while len(front):  # the next occurrence beyond each that was kept, within its run
            front = np.searchsorted(place, place[front] + k)
            front = front[(front < len(at))]
            front = front[~kept[front]]
            kept[front] = True
    at, key = at[kept], key[kept]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
    seen = np.diff(first, append=len(at))
    weight = np.add.reduceat(size[at + k] - size[at], first) if len(at) else np.zeros(0, np.int64)
    at = at[first]
    # Rows of one group are added up.
    group = np.zeros(len(lists), np.int64)
    for name in by:
        codes_of = batch.column(batch.schema.get_field_index(name)).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        group = np.unique(group * (codes_of.max(initial=0) + 1) + codes_of, return_inverse=True)[1]
    number = gram[order][kept][first]
    both = group[row[at]] * (number.max(initial=0) + 1) + number
    _, one, where = np.unique(both, return_index=True, return_inverse=True)
    added = []
    for values in (seen, weight, np.ones(len(at), np.int64)):
        out = np.zeros(len(one), np.int64)
        np.add.at(out, where, values)
        added.append(pa.array(out))
    at = at[one]
    symbol = flat.dictionary.cast(pa.string())
    pattern = pc.binary_join_element_wise(*[symbol.take(pa.array(codes[at + j])) for j in range(k)], _JOINT)
    own = [batch.column(batch.schema.get_field_index(name)).take(pa.array(row[at])) for name in by]
    return pa.RecordBatch.from_arrays([*own, pattern, *added], names=[*by, "pattern", "n", "bytes", "rows"])


def _any(symbol: Column, parts: list[str]) -> Column:
    out = F.contains(symbol, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(symbol, F.lit(p))
    return out


def heldout_macros(rows: DataFrame, package: str, klass: str, folds: int = 5, candidates: int = 300, least_count: int = 20, least_packages: int = 3, symbols: str = "opcodes", sizes: str = "sizes", lengths: range = range(4, 9), informative: list[str] | None = INFORMATIVE) -> DataFrame:
    """``fold, pattern, train_occurrences, train_packages, test_occurrences, test_classes, net_savings`` of each fold's candidates.

    A fold holds the packages whose hash falls in it.  On the other folds a pattern is a candidate if it
    occurs often enough and saves bytes; the best by (estimate, pattern) are kept, then those seen in
    enough packages.  Net savings are counted on the fold itself.
    """
    marked = rows.withColumn("own_fold", hash_fold(F.col(package), folds))
    # The counts are read three times.  Written, their size is known: a plan over small sequences would send all patterns to every task.
    found = written(pattern_counts(marked, [package, klass, "own_fold"], symbols, sizes, lengths, informative), "patterns")
    by_pattern = found.groupBy("own_fold", "pattern").agg(F.sum("n").alias("n"), F.sum("bytes").alias("b"))
    every = rows.sparkSession.range(folds).select(F.col("id").alias("fold"))
    train = by_pattern.join(F.broadcast(every), F.col("own_fold") != F.col("fold")).groupBy("fold", "pattern").agg(F.sum("n").alias("train_occurrences"), F.sum("b").alias("train_bytes"))
    mean = F.col("train_bytes") / F.col("train_occurrences")
    estimate = F.col("train_occurrences") * (mean - REFERENCE_BYTES) - mean - CLASS_BYTES
    scored = train.where(F.col("train_occurrences") >= least_count).withColumns({"definition_bytes": mean, "estimate": estimate}).where(F.col("estimate") > 0)
    best = Window.partitionBy("fold").orderBy(F.desc("estimate"), F.desc("symbols"))
    chosen = scored.withColumn("symbols", unpacked("pattern")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= candidates)
    chosen = written(chosen, "candidates")
    seen = found.join(F.broadcast(chosen.select("fold", "pattern")), "pattern")
    packages = seen.where(F.col("own_fold") != F.col("fold")).groupBy("fold", "pattern").agg(F.count_distinct(package).alias("train_packages"))
    test = seen.where(F.col("own_fold") == F.col("fold")).groupBy("fold", "pattern").agg(F.sum("n").alias("test_occurrences"), F.sum("bytes").alias("test_bytes"), F.count_distinct(klass).alias("test_classes"))
    out = chosen.join(packages.where(F.col("train_packages") >= least_packages), ["fold", "pattern"]).join(test, ["fold", "pattern"], "left")
    out = out.na.fill(0, ["test_occurrences", "test_bytes", "test_classes"])
    net = F.col("test_bytes") - REFERENCE_BYTES * F.col("test_occurrences") - F.col("definition_bytes") - CLASS_BYTES * F.col("test_classes")
    return out.select("fold", F.col("symbols").alias("pattern"), "train_occurrences", "train_packages", "test_occurrences", "test_classes", net.alias("net_savings"))


def fold_summary(macros: DataFrame) -> DataFrame:
    """For each fold: candidates, those that save on held-out rows, and the best saving (0 where none does)."""
    return macros.groupBy("fold").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("net_savings") > 0).alias("positive"), F.greatest(F.max("net_savings"), F.lit(0.0)).alias("best"))


def version_diff(older: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """Keys with ``change``: retained, added or removed; one full outer join."""
    a = older.select(key).distinct().withColumn("in_old", F.lit(True))
    b = newer.select(key).distinct().withColumn("in_new", F.lit(True))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("retained")
    return a.join(b, key, "full").select(key, change.alias("change"))


def diff_summary(diff: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(F.col("change") == c)
    made = diff.agg(count("retained").alias("retained"), count("added").alias("added"), count("removed").alias("removed"))
    older, newer = F.col("retained") + F.col("removed"), F.col("retained") + F.col("added")
    return made.withColumns({"net": newer - older, "growth_pct": percent_growth(newer, older), "retention": F.try_divide(F.col("retained").cast("double"), older)})


def adoption(diff: DataFrame, calls: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """For each added key: calls from anywhere and from retained callers, and the bytes that the latter save.

    *calls* has ``caller, callee`` keys of the newer snapshot, *sizes* the key and ``bytes``.
    """
    added = diff.where(F.col("change") == "added").select(F.col(key).alias("callee"))
    kept = diff.where(F.col("change") == "retained").select(F.col(key).alias("caller"), F.lit(1).alias("kept"))
    used = calls.join(added, "callee", "left_semi").join(kept, "caller", "left")
    made = used.groupBy("callee").agg(F.count(F.lit(1)).alias("uses"), F.count("kept").alias("retained_uses"))
    each = F.greatest(F.col("bytes").cast("bigint") - REFERENCE_BYTES, F.lit(0))
    return made.join(sizes.select(F.col(key).alias("callee"), "bytes"), "callee").select("callee", "uses", "retained_uses", "bytes", (F.col("retained_uses") * each).alias("gross_bytes"))
