"""Language ID by hierarchical discrimination.

A text's language family is predicted first; within the family, one-versus-one
linear support vector machines separate the related languages.  Features are
hashed byte n-grams of words, counted over the whole text: a text's decision
value is the sum of its n-grams' weights divided by their number, so that one
gather and one sum per classifier score it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.bytes_np import CHUNK_BYTES, IS_WORDISH, LOWER, chunks

UNDETERMINED = "und"

# Families of languages, by ISO 639-1 code.  A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].split("_")[0].lower(), lang)


@dataclass
class LanguageModel:
    """Weights for each n-gram bucket and each binary classifier; the size is set by the parameters, not by the data."""

    buckets: int
    orders: tuple[int, ...]
    langs: list[str]
    families: list[str]
    members: list[list[int]]  # languages of each family
    family_pairs: list[tuple[int, int, int]]  # (family, family, classifier)
    lang_pairs: list[tuple[int, int, int]]
    weights: np.ndarray  # buckets x classifiers
    bias: np.ndarray


def gram_buckets(data: np.ndarray, orders: tuple[int, ...], buckets: int) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that ends at each byte.

    Bytes that are no letters are one blank; n-grams hold at most one blank, at their start or end,
    so that they stay within a word; others, and those reaching before the data, have bucket 0.
    """
    low = LOWER[data]
    low = np.where(IS_WORDISH[low] & ~((low >= 48) & (low <= 57)), low, np.uint8(32)).astype(np.uint32)
    blank = low == 32
    for order in orders:
        h = np.zeros(len(low), np.uint32)
        bad = np.zeros(len(low), bool)
        for k in range(order):
            h[order - 1 :] = h[order - 1 :] * np.uint32(0x01000193) + low[k : len(low) - order + 1 + k] if len(low) >= order else 0
            if 0 < k < order - 1 and len(low) >= order:
                bad[order - 1 :] |= blank[k : len(low) - order + 1 + k]
        if order == 1:
            bad |= blank
        elif len(low) >= order:
            bad[order - 1 :] |= blank[order - 1 :] & blank[: len(low) - order + 1]
        h = (h * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(7)
        h %= np.uint32(buckets - 1)
        h += np.uint32(1)
        h[bad] = 0
        h[: order - 1] = 0
        yield h


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A blank before each row, and one after the last, so that n-grams don't cross rows unseen."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[:-1] + np.arange(n)] = False
    keep[-1] = False
    out[keep] = data
    return out, np.append(offsets[:-1] + np.arange(n), len(out) - 1)


def feature_counts(data: np.ndarray, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """Counts of a text's n-gram buckets; bucket 0 is always empty."""
    total = np.zeros(buckets, np.float32)
    padded, _ = _padded(data, np.array([0, len(data)]))
    for h in gram_buckets(padded, orders, buckets):
        total += np.bincount(h, minlength=buckets)
    total[0] = 0
    return total


def _svm(x: np.ndarray, y: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge loss, L2) by dual coordinate descent; *y* is -1 or 1."""
    rng = np.random.default_rng(seed)
    n, _ = x.shape
    w = np.zeros(x.shape[1] + 1)
    alpha = np.zeros(n)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    diag = 1 / (2 * cost * weight)
    q = (x * x).sum(1) + 1 + diag
    for _ in range(rounds):
        for i in rng.permutation(n):
            g = y[i] * (x[i] @ w[:-1] + w[-1]) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                w[:-1] += (new - alpha[i]) * y[i] * x[i]
                w[-1] += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", sample: int = 1200, languages: int | None = None, buckets: int = 1 << 13, orders: tuple[int, ...] = (1, 2, 3, 4), cost: float = 20.0, rounds: int = 6) -> LanguageModel:
    """Fit the classifiers on a bounded sample of labelled rows.

    *learn* says which rows may be used; rows without text or language never are.  *sample* is the
    bound of the distinct texts in all, shared evenly by the languages, of which each has one at least; a
    language's texts are those of the smallest hashes.  A text that is repeated counts once for a language, however often it is there,
    so that copies take no other text's or language's place.  Every language that occurs can be
    predicted, unless *languages* asks for those of most distinct texts only (of equal ones the first by name); there is a classifier for each pair of families and of languages within one.  Each sampled text gives its whole n-gram
    profile and that of a few of its words, so that short texts are learnt as well.  Raises
    ``ValueError`` where no row is labelled, as in an empty table.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("body"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("body", 0.02).alias("n")).collect()}
    sizes = dict(sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[:languages])
    if not sizes:
        raise ValueError("no labelled rows to learn languages from")
    each = max(1, sample // len(sizes))
    share = F.create_map(*[x for code, n in sizes.items() for x in (F.lit(code), F.lit(min(1.0, (1.2 * each + 20) / n)))])[F.col("lang")]
    order = F.pmod("body", F.lit(1 << 30))
    once = rows.withColumn("__order", order).where(F.col("__order") < share * (1 << 30)).groupBy("lang", "__order", "body").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("__order", "body"))
    drawn = once.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "text", "__order")

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, where, at, count = [], [], [], []
            for code, value, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = value.split()
                few = words[h % max(1, len(words) - 8) :][:8]
                for piece in (value, " ".join(few)):
                    counts = feature_counts(np.frombuffer(piece.encode(), np.uint8), orders, buckets)
                    langs.append(code)
                    where.append(h)
                    kept = np.flatnonzero(counts)
                    at.append(kept.astype(np.int16 if buckets <= 1 << 15 else np.int32).tobytes())
                    count.append(counts[kept].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(where, pa.int64()), pa.array(at, pa.binary()), pa.array(count, pa.binary())], ["lang", "h", "at", "n"])

    got = sorted(drawn.mapInArrow(profiles, "lang string, h bigint, at binary, n binary").collect(), key=lambda r: (r["h"], r["lang"], len(r["at"]), bytes(r["at"])))
    langs = sorted(sizes)
    code_at = {code: k for k, code in enumerate(langs)}
    x = np.zeros((len(got), buckets), np.float32)
    y = np.zeros(len(got), np.int64)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.int16 if buckets <= 1 << 15 else np.int32)] = np.frombuffer(r["n"], np.float32)
        y[i] = code_at[r["lang"]]
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    scale = 1 / np.sqrt((x * x).mean(0) + 1e-7)  # common n-grams do not drown the rest
    scale[0] = 0
    scale /= np.sqrt(((x * scale) ** 2).sum(1)).mean() + 1e-12
    x *= scale
    families = sorted({family_of(code) for code in langs})
    family = np.array([families.index(family_of(code)) for code in langs])
    members = [[k for k, code in enumerate(langs) if family_of(code) == f] for f in families]
    weights, bias = [], []

    def fit(positive: np.ndarray, negative: np.ndarray) -> int:
        rows = np.flatnonzero(positive | negative)
        w, b = _svm(x[rows], np.where(positive[rows], 1.0, -1.0), cost, rounds, len(weights))
        weights.append(w)
        bias.append(b)
        return len(weights) - 1

    family_pairs = [(a, b, fit(family[y] == a, family[y] == b)) for a, b in combinations(range(len(families)), 2)]
    lang_pairs = [(a, b, fit(y == a, y == b)) for own in members for a, b in combinations(own, 2)]
    table = np.array(weights).T * scale[:, None] if weights else np.zeros((buckets, 1))
    return LanguageModel(buckets, orders, langs, families, members, family_pairs, lang_pairs, table.astype(np.float32), np.array(bias or [0.0]))


def decide(model: LanguageModel, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores from the classifiers' values (texts x classifiers): the family first, then the language in it."""
    n = len(values)
    chance = 1 / (1 + np.exp(-np.clip(4 * values, -30, 30)))

    def vote(pairs: list[tuple[int, int, int]], options: list[int]) -> tuple[np.ndarray, np.ndarray]:
        won = np.zeros((n, len(options)))
        at = {o: k for k, o in enumerate(options)}
        for a, b, c in pairs:
            won[:, at[a]] += (values[:, c] > 0) + 1e-3 * chance[:, c]
            won[:, at[b]] += (values[:, c] <= 0) + 1e-3 * (1 - chance[:, c])
        best = won.argmax(1)
        sure = np.ones(n)
        for a, b, c in pairs:
            sure = np.where(best == at[a], np.minimum(sure, chance[:, c]), np.where(best == at[b], np.minimum(sure, 1 - chance[:, c]), sure))
        return best, sure

    family, sure = vote(model.family_pairs, list(range(len(model.families))))
    lang = np.zeros(n, np.int64)
    for f, own in enumerate(model.members):
        best, within = vote([p for p in model.lang_pairs if p[0] in own], own)
        mine = family == f
        lang[mine] = np.array(own)[best[mine]]
        sure = np.where(mine, sure * within, sure)
    return lang, sure


def scores(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The classifiers' values for each row of a chunk."""
    padded, begins = _padded(data, offsets)
    n = len(begins) - 1
    total = np.zeros((n, model.weights.shape[1]))
    grams = np.zeros(n)
    step = CHUNK_BYTES
    columns = np.ascontiguousarray(model.weights.T)
    for h in gram_buckets(padded, model.orders, model.buckets):
        if len(padded) <= 2 * step:  # a row's n-grams end in its text or at the blank after it
            grams += np.add.reduceat((h > 0).astype(np.float64), begins[:-1] + 1)
            for c in range(model.weights.shape[1]):
                total[:, c] += np.add.reduceat(columns[c][h], begins[:-1] + 1, dtype=np.float64)
        else:  # one very long text
            for lo in range(0, len(h), step):
                piece = h[lo : lo + step]
                grams[0] += np.count_nonzero(piece)
                total[0] += [float(w[piece].sum(dtype=np.float64)) for w in columns]
    return total / np.maximum(grams, 1)[:, None] + model.bias


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Predict the language of every whole text.

    Adds ``lang_pred`` and ``score`` (0 to 1) to the *carry* columns (default: all); columns of those
    names are replaced.  Null texts and texts without any letter are ``und`` with score 0.  Of languages
    (or families) with equal votes the first by name wins.  Equal texts get equal results; an empty table
    gives an empty table.  One pass over the table, no shuffle; only predictions come back from Python.
    """
    names = ["lang_pred", "score"]
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ascii_letter = np.array([chr(b).isalpha() if b < 128 else False for b in range(256)])

    def told(column: pa.Array) -> pa.Array:
        m = shared.value
        codes = np.array(m.langs, dtype=object)
        lang, sure = [], []
        for _, _, data, offsets in chunks(column):
            best, score = decide(m, scores(m, data, offsets))
            found = codes[best]
            seen = np.zeros(len(data) + 1, np.int64)
            np.cumsum(ascii_letter[data], out=seen[1:])
            for i in np.flatnonzero(seen[offsets[1:]] == seen[offsets[:-1]]):
                if not any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))):
                    found[i], score[i] = UNDETERMINED, 0.0
            lang.extend(found)
            sure.append(score)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(sure) if sure else np.zeros(0), pa.float64())], names)

    # Not deterministic, for the optimiser: a filter on the prediction must not predict once more.
    predicted = F.arrow_udf(told, "lang_pred string, score double").asNondeterministic()
    kept = [F.col(f"`{c}`") for c in carry]
    return docs.select(*kept, predicted(F.col(f"`{text}`").cast("string")).alias("__told")).select(*kept, "__told.lang_pred", "__told.score")
