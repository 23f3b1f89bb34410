"""Operators over whole corpora: language models, similarity joins, decontamination, fingerprints, the pipeline."""

import collections
import io
import math
import random
import re
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import chroma, components, decontaminate, lm_score, ngram_jaccard
from weftline.llm.bytes_np import chunks


# --- language model


def _tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</s>"]


@pytest.mark.parametrize("order, fanout", [(2, 128), (3, 128), (3, 2)])
def test_model_by_brute_force(spark, order, fanout):
    """Every text's log-probability by the smoothing formula; with a fan-out of two the runs are added up by a tree."""
    rng = random.Random(2)
    words = ["a", "B", "cc", "dé", "e."]
    rows = [(k, k % 5 == 1, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for k in range(80)] + [(90, False, None), (91, True, "unseen words"), (92, False, " \t"), (3, False, "a b a b"), (None, True, "a B")]
    rows += [(200 + k, k % 2 == 0, " ".join(rng.choice([*words, "odd"]) for _ in range(2 * lm_score.STRETCH + k))) for k in range(-1, 4)]  # texts of several stretches
    df = spark.createDataFrame(rows, "doc_id bigint, held_out boolean, text string").withColumn("score", F.lit("x"))
    # Histories start with as many begin marks as they have words.
    marked = {t: ["<s>"] * (order - 1) + _tokens(t) for _, _, t in rows}
    counts, past = collections.Counter(), collections.Counter()
    for _, held, text in rows:
        t = marked[text]
        for i in range(order - 1, len(t)):
            for k in range(order):
                counts[tuple(t[i - k : i + 1])] += not held
                past[tuple(t[i - k : i])] += not held
    n, v = past[()], sum(c > 0 and len(g) == 1 for g, c in counts.items())
    strength = (30.0, 2.0)

    def chance(history, word):
        if not history:
            return (counts[(word,)] + 0.5) / (n + 0.5 * (v + 1))
        lower = chance(history[1:], word)
        m = strength[len(history) - 1]
        return (counts[(*history, word)] + m * lower) / (past[history] + m)

    got = lm_score.score(df, ~F.col("held_out"), carry=["doc_id", "held_out"], block_bytes=600, strength=strength, order=order, fanout=fanout, hash_bits=(60, 58, 58)).collect()
    assert len(got) == len(rows)
    by_text = collections.defaultdict(list)
    for r in got:
        by_text[r["doc_id"]].append(r)
    for d, held, text in rows:
        t = marked[text]
        at = range(order - 1, len(t))
        base = sum(math.log10(chance((), t[i])) for i in at)
        total = sum(math.log10(chance(tuple(t[i - order + 1 : i]), t[i])) for i in at)
        known = sum(counts[(t[i],)] > 0 for i in at)
        assert any(
            r["n_tokens"] == len(at) and r["n_known"] == known and r["train_tokens"] == n and math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], total, rel_tol=1e-9) for r in by_text[d]
        ), (d, text)


def test_automaton_follows_failure_arcs():
    """The states of one traversal are the longest histories that training holds."""
    texts = ["a b c a b", "b c d", "z a b z c"]
    learn = [True, True, False]
    grams = lm_score._Grams(pa.array(texts, pa.large_string()), 3, (60, 58, 58))
    counts = [lm_score._learnt(g, np.repeat(learn, grams.per))[1] for g in grams.hashes]
    machine = lm_score.Automaton(grams, counts, 10, 5, 2, (30.0, 2.0))
    seen = {tuple((["<s>"] * 2 + _tokens(t))[i : i + k]) for t in texts[:2] for k in (1, 2) for i in range(0, len(_tokens(t)) + 3 - k)}
    name = {}  # states that were met, by history
    for t, first, per in zip(texts, grams.first, grams.per):
        state, past = np.array([machine.start]), ["<s>", "<s>"]
        for i in range(per):
            state, _ = machine.step(state, machine.words[first + i : first + i + 1])
            past.append(_tokens(t)[i])
            longest = next((tuple(past[-k:]) for k in (2, 1) if tuple(past[-k:]) in seen), ())
            assert name.setdefault(longest, int(state[0])) == int(state[0]) and (longest == ()) == (state[0] == 0)
    assert len(set(name.values())) == len(name) > 6


def test_ngrams_are_told_apart_by_one_sort(monkeypatch):
    """op4_lm_score: values, first places and which is where, as numpy's search gives them, which a block does not run."""
    rng = np.random.default_rng(4)
    for size, top in ((0, 1), (1, 1), (500, 40), (500, 2**62)):
        values = rng.integers(0, top, size, dtype=np.uint64)
        for got, want in zip(lm_score._distinct(values), np.unique(values, return_index=True, return_inverse=True), strict=True):
            assert got.tolist() == want.tolist()
    monkeypatch.setattr(np, "unique", lambda *a, **k: pytest.fail("searched"))
    grams = lm_score._Grams(pa.array(["a b a", "b", ""], pa.large_string()), 3, (60, 46, 46))
    counts = [lm_score._learnt(g, np.ones(len(g), bool))[1] for g in grams.hashes]
    machine = lm_score.Automaton(grams, counts, 7, 3, 3, (30.0, 2.0))
    assert machine.traverse(grams.first, grams.per).shape == (3,)
    merge = lm_score._Merge([lm_score._pack(np.array(v, np.uint64), np.ones(len(v), np.int64)) for v in ([1, 5], [5, 9], [])])
    assert (merge.values.tolist(), merge.counts.tolist()) == ([1, 5, 9], [1, 2, 1])



def test_model_is_a_distribution(spark):
    """Probabilities of all continuations of a history sum to one, the unknown word included."""
    vocab = ["a", "b", "c"]
    train = [(k, " ".join(vocab[(k * i) % 3] for i in range(1, 9))) for k in range(12)]
    asked = [(100 + i, f"a b {w}") for i, w in enumerate([*vocab, "unknown", ""])]
    df = spark.createDataFrame([(d, t, True) for d, t in train] + [(d, t, False) for d, t in asked], "doc_id bigint, text string, learn boolean")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, F.col("learn"), carry=["doc_id"], order=3).collect()}
    end = got[104]  # "a b" and the end
    # p(end | a b w) is shared by no other text, so the sum is taken over the first three tokens by a second query.
    more = spark.createDataFrame([(200 + i, f"a b {w} {w}", False) for i, w in enumerate([*vocab, "unknown"])], "doc_id bigint, text string, learn boolean")
    assert end < 0 and lm_score.score(df.unionByName(more), F.col("learn"), carry=["doc_id"], order=3).count() == df.count() + 4
    assert lm_score.score(df.limit(0), F.col("learn"), carry=["doc_id"]).count() == 0


# --- near duplicates


def _sets(text, k):
    w = _tokens(text)[:-1]
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def _classes(rows, k, num, den):
    sets = [(d, _sets(t, k)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: find(d) for d in parent}


@pytest.mark.parametrize("words,num", [(4, 85), (5, 80)])
def test_near_duplicates_by_brute_force(spark, words, num):
    rng = random.Random(words)
    vocab = [f"v{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (3, 9, 30, 80, 160, 160, 300)]
    rows = []
    for k in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(vocab)]
        if k % 7 == 0:
            w = [rng.choice(vocab) for _ in range(60)] + passage
        rows.append((k * 3 % 151, " ".join(w).upper() if k % 11 == 0 else "  ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a b"), (504, "A\tb"), (505, rows[0][1]), (505, rows[1][1]), (None, rows[2][1])]
    got = ngram_jaccard.near_duplicates(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, n_shingles int"), words=words, num=num, den=100).collect()
    want = _classes(rows, words, num, 100)
    assert len(got) == len(rows) and len(set(want.values())) < len(want) - 20
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    sizes = collections.Counter((d, len(_sets(t, words))) for d, t in rows)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes


def test_near_duplicates_of_an_empty_table(spark):
    assert ngram_jaccard.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_alike_but_unlinked_texts_take_few_rounds(spark, monkeypatch):
    """Texts that are all alike but below the threshold: every pair is refuted in the fixed number of turns."""
    rng = random.Random(17)
    shared = [f"s{k}" for k in range(120)]
    rows = [(d, " ".join([*shared, *(f"d{d}x{k}" for k in range(22))])) for d in range(90)]
    rows += [(200 + d, " ".join([*shared, *(f"e{k}" for k in range(22)), f"z{d}"])) for d in range(30)]
    rng.shuffle(rows)
    calls, after = [], ngram_jaccard._after
    monkeypatch.setattr(ngram_jaccard, "_after", lambda *a: calls.append(1) or after(*a))
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=4, num=85, den=100).collect()}
    assert got == _classes(rows, 4, 85, 100) and len(set(got.values())) == 91
    assert len(calls) == 2 + len(ngram_jaccard.TURNS)


def test_blocks_of_linked_sets_share_a_kept_key():
    rng = np.random.default_rng(7)
    bands = ngram_jaccard.Bands(85, 100)
    for _ in range(400):
        n = int(rng.integers(8, 400))
        a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        cut, more = int(rng.integers(0, max(1, len(a) // 9))), int(rng.integers(0, max(1, len(a) // 9)))
        b = np.unique(np.concatenate([a[cut:], rng.integers(1, 1 << 62, more).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        small, large = sorted((a, b), key=len)
        band = bands.of(len(small))
        assert bands.of(len(large)) in (band, band + 1)
        differ, by_bits, by_buckets = bands.blocks(band)
        shared = np.intersect1d(ngram_jaccard._kept_blocks(small, band, bands), ngram_jaccard._kept_blocks(large, band, bands))
        assert len(shared) >= 1 + by_buckets


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([*links, (7, 7)], "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# --- decontamination


def _best_edits(item, words):
    """Least word edits between an item and any stretch of words."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(words):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_window_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        item = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 9))], np.uint64)
        words = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 14))], np.uint64)
        edits, a, b = decontaminate.edit_window(item, words)
        assert edits == _best_edits(item.tolist(), words.tolist())
        assert 0 <= a <= b <= len(words)


def test_leaks_against_brute_force(spark):
    rng = random.Random(31)
    vocab = [f"w{k}" for k in range(900)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(14, 60)))) for k in range(30)]
    rows = []
    for d in range(200):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 150))]
        if d % 2:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, int(0.2 * len(leak)) + 1)):
                at = rng.randrange(len(leak))
                leak[at : at + rng.randrange(2)] = [rng.choice(vocab)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = leak
        rows.append((d, " ".join(words).title() + "."))
    rows += [(900, None), (901, ""), (902, "..."), (3, rows[3][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*items, (99, None), (98, "...")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.matches(docs, bench).collect()}
    want = {}
    for d, t in rows:
        words = re.findall(r"[a-z0-9]+", (t or "").lower())
        for k, text in items:
            e = _best_edits(text.split(), words)
            if e <= int(0.2 * len(text.split())):
                want[d, k] = e
    assert set(got) <= set(want) and all(got[x] == want[x] for x in got)
    assert len(got) >= 0.9 * len(want) and len(want) > 80
    blocks = decontaminate.matches(docs, bench, block_bytes=1500)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} >= {x for x in got if want[x] == 0}
    dirty = {d for d, _ in got}
    kept = sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect())
    assert kept == sorted(d for d, _ in rows if d not in dirty)
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_windows_of_any_chunk_give_the_same_leaks():
    items = decontaminate.Items([1], ["one two three four five six seven eight nine ten"], decontaminate.Plan())
    texts = ["zero one two three four five six seven eight nine ten eleven", "nothing here", "one two three four five six seven eight nine ten"]
    for limit in (10, 1 << 20):
        found = set()
        for lo, _, data, offsets in chunks(pa.array(texts), limit):
            h, per, _, _ = decontaminate.word_hashes(data, offsets)
            found |= {(lo + r, k) for r, k, *_ in decontaminate._search(items, h, per)}
        assert found == {(0, 1), (2, 1)}


def _found(items, texts, limit=1 << 20):
    found = set()
    for lo, _, data, offsets in chunks(pa.array(texts), limit):
        h, per, _, _ = decontaminate.word_hashes(data, offsets)
        found |= {(lo + r, *rest) for r, *rest in decontaminate._search(items, h, per)}
    return found


def _edited(rng, words, edits):
    out = list(words)
    for k in range(edits):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = [f"x{rng.randrange(1000)}"] * rng.randrange(2)
    return out


@pytest.mark.parametrize("n", [*range(1, 14), 14, 25, 36, 59])
def test_recall_of_items_at_the_most_edits(n):
    """Of passages with as many edits as an item may have, nine tenths are found at every length; nothing else is."""
    rng = random.Random(100 + n)
    vocab = [f"w{k}" for k in range(2000)]
    draw = lambda size: [rng.choice(vocab) for _ in range(size)]
    originals = [draw(n) for _ in range(20)]
    items = decontaminate.Items(list(range(20)), [" ".join(w) for w in originals], decontaminate.Plan())
    texts = [draw(rng.randrange(20)) + _edited(rng, w, int(0.2 * n)) + draw(rng.randrange(20)) for w in originals * 3]
    want = {(d, k, e) for d, t in enumerate(texts) for k, w in enumerate(originals) if set(w) & set(t) and (e := _best_edits(w, t)) <= int(0.2 * n)}
    got = {x[:3] for x in _found(items, [" ".join(t) for t in texts])}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 55


@pytest.mark.parametrize("n", [50, 100, 200, 400, 1000])
def test_leaks_of_every_length_and_edit_rate(n):
    rng = random.Random(n)
    vocab = [f"w{k}" for k in range(2000)]
    draw = lambda size: [rng.choice(vocab) for _ in range(size)]
    originals = [draw(n) for _ in range(4)]
    items = decontaminate.Items(list(range(4)), [" ".join(w) for w in originals], decontaminate.Plan())
    for share in (0, 0.1, 0.2):
        texts, want = [], set()
        for k, w in enumerate(originals):
            for around in (0, 30):
                words = draw(around) + _edited(rng, w, int(share * n)) + draw(around)
                want.add((len(texts), k, _best_edits(w, words)))
                texts.append(" ".join(words))
        got = {x[:3] for x in _found(items, texts)}
        assert got <= want and len(got) >= 0.9 * len(want)


def test_leaks_of_short_items_by_brute_force():
    rng = random.Random(8)
    originals = [[rng.choice("abcde") for _ in range(n)] for n in range(1, 25)]
    items = decontaminate.Items(list(range(24)), [" ".join(w) for w in originals], decontaminate.Plan())
    texts = [[rng.choice("abcdef") for _ in range(rng.randrange(0, 60))] for _ in range(60)]
    best = {(d, k, _best_edits(w, t)) for d, t in enumerate(texts) for k, w in enumerate(originals)}
    want = {x for x in best if x[2] <= int(0.2 * len(originals[x[1]]))}
    got = {x[:3] for x in _found(items, [" ".join(t) for t in texts])}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 50


@pytest.mark.parametrize("n", [50, 200])
def test_long_leaks_do_not_depend_on_the_rows_before(n):
    rng = random.Random(n + 1)
    draw = lambda size: [f"w{rng.randrange(2000)}" for _ in range(size)]
    originals = [draw(n) for _ in range(10)]
    items = decontaminate.Items(list(range(10)), [" ".join(w) for w in originals], decontaminate.Plan())
    copies = [" ".join(_edited(rng, w, int(0.15 * n))) for w in originals]
    texts = [x for k, copy in enumerate(copies) for x in (copy, " ".join(draw(rng.randrange(1, 40))), copy)]
    whole = _found(items, texts)
    assert {x[:2] for x in whole} == {(3 * k + at, k) for k in range(10) for at in (0, 2)}
    assert {(r - 2, *rest) for r, *rest in whole if r % 3 == 2} == {x for x in whole if x[0] % 3 == 0}
    assert all(_found(items, texts, limit) == whole for limit in (10, 3000))


def test_items_with_a_null_id_are_found(spark):
    docs = spark.createDataFrame([(1, "x one two three four five y"), (2, "nothing here")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "one two three four five")], "item_id bigint, text string")
    assert [tuple(r)[:3] for r in decontaminate.matches(docs, bench).collect()] == [(1, None, 0)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [2]


# --- fingerprints


def _wav(x, rate=chroma.RATE):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(x, -32000, 32000).astype("<i2").tobytes())
    return out.getvalue()


def test_recordings_align_at_their_shift(spark):
    rng = np.random.default_rng(4)
    tune = chroma.decode(chroma.sonify(rng.normal(size=120)))
    other = chroma.decode(chroma.sonify(rng.normal(size=120)))
    shift = 9 * chroma.HOP
    rows = [(0, _wav(tune)), (1, _wav(tune[shift:] + rng.normal(size=len(tune) - shift) * 60)), (2, _wav(other)), (3, _wav(tune)), (4, None), (5, b"broken"), (6, _wav(tune[:500])), (None, _wav(other))]
    got = {r["rec"]: r for r in chroma.align(spark.createDataFrame(rows, "rec bigint, media binary"), F.col("rec") % 100 == 0).collect()}
    assert len(got) == len(rows) and got[3]["class_id"] == 0 and got[2]["class_id"] == 2
    assert [(m["class_id"], m["offset"]) for m in got[0]["matches"]] == [(1, -9)] and got[0]["matches"][0]["bit_error"] < 0.1
    for k in (4, 5, 6):
        assert got[k]["class_id"] is None and got[k]["n_items"] == 0 and got[k]["matches"] == []
    assert got[0]["codes_sha256"] == chroma.digest(rows[0][1]) and got[None]["class_id"] is None
    assert chroma.align(spark.createDataFrame([], "rec bigint, media binary"), F.lit(True)).count() == 0


def _aligned(x, y, max_error=0.25, min_overlap=8):
    """The best matching offset of two fingerprints, by brute force: ``(offset, votes, overlap)`` or None."""
    found = []
    for offset in range(1 - len(x), len(y)):
        lo = max(0, -offset)
        a, b = x[lo : min(len(x), len(y) - offset)], y[lo + offset : min(len(x), len(y) - offset) + offset]
        error = sum(int(u ^ v).bit_count() for u, v in zip(a.tolist(), b.tolist())) / (32 * max(1, len(a)))
        if len(a) >= min_overlap and error <= max_error:
            found.append((-int((a == b).sum()), error, abs(offset), offset, len(a)))
    return (min(found)[3], -min(found)[0], min(found)[4]) if found else None


def test_noisy_codes_align_up_to_the_limit():
    rng = np.random.default_rng(12)
    x = rng.integers(0, 1 << 32, 50, dtype=np.uint32)
    rows = []
    for share in (0, 0.1, 0.2, 0.25, 0.3):
        bits = np.zeros(32 * 50, np.uint8)
        bits[rng.choice(32 * 50, int(share * 32 * 50), replace=False)] = 1
        noisy = x ^ np.packbits(bits).view(np.uint32)
        rows.append(np.concatenate([rng.integers(0, 1 << 32, int(rng.integers(0, 9)), dtype=np.uint32), noisy]))
    want = [_aligned(x, y) for y in rows]
    assert [w is not None for w in want] == [True] * 4 + [False]
    got = {}
    for own, table, sizes in chroma._slices(rows, 120):
        for c, offset, _, overlap in zip(*chroma.offsets_of(x, table, sizes, 0.25, 8)):
            got[int(own[c])] = (int(offset), int(overlap))
    assert got == {k: (w[0], w[2]) for k, w in enumerate(want) if w}


def test_noisy_recordings_against_brute_force(spark):
    rng = np.random.default_rng(14)
    rows = []
    for k in range(6):
        tune = chroma.decode(chroma.sonify(rng.normal(size=60)))
        rows.append((100 * k, _wav(tune)))
        for i, noise in enumerate((1000, 3000, 6000, 9000)):
            cut = int(rng.integers(0, 4)) * chroma.HOP
            rows.append((100 * k + i + 1, _wav(tune[cut:] + rng.normal(size=len(tune) - cut) * noise)))
    codes = {k: chroma.fingerprint(chroma.decode(media)) for k, media in rows}
    got = {r["rec"]: {m["class_id"]: (m["offset"], m["votes"], m["overlap"]) for m in r["matches"]} for r in chroma.align(spark.createDataFrame(rows, "rec bigint, media binary"), F.col("rec") % 100 == 0, block_bytes=500).collect()}
    for q in range(0, 600, 100):
        best = {k: _aligned(codes[q], y) for k, y in codes.items() if k != q}
        assert got[q] == {k: v for k, v in best.items() if v}
    assert sum(len(v) for v in got.values()) > 12


def test_filters_by_direct_sums():
    x = chroma.decode(chroma.sonify(np.random.default_rng(1).normal(size=30)))
    codes, e = chroma.fingerprint(x), chroma.chroma(x)
    kind, p, h, w = chroma.FILTERS[2]
    assert kind == 2
    wide = np.concatenate([e, e], 1)
    t = 5
    a, b = wide[t + w // 2 : t + w, p : p + h].sum(), wide[t : t + w // 2, p : p + h].sum()
    v = np.log1p(a) - np.log1p(b)
    level = int(v > -0.25) + int(v > 0) + int(v > 0.25)
    assert int(codes[t]) >> 26 & 3 == level ^ level >> 1


def test_sonify_of_nulls(spark):
    rows = spark.createDataFrame([(1, [0.0, None]), (2, None), (3, [])], "vec_id bigint, embedding array<float>")
    got = {r["rec"]: r["n_items"] for r in chroma.fingerprints(chroma.sonified(rows, "vec_id", "embedding")).collect()}
    assert got == {1: 0, 2: 0, 3: 0}


# --- pipeline


def test_pipeline_keeps_and_drops(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    words = {"en": ["the", "thing", "with", "other", "house"], "de": ["und", "nicht", "schön", "haus", "wetter"]}
    item = " ".join(f"item{k}" for k in range(20))
    rows = [(d, " ".join(rng.choice(words["en" if d % 2 else "de"]) + str(rng.randrange(500)) for _ in range(30)), "en" if d % 2 else "de", "s", 1) for d in range(40)]
    line = "this very line is in many of the documents, and long"
    rows += [(100 + k, f"document{k} alone{k * 7}\n{line}", "en", "s", 1) for k in range(6)]
    rows += [(200, rows[0][1], "de", "s", 1), (201, "12 34 !!", None, "s", 1), (202, None, None, None, None), (203, f"before {item} after", "en", "s", 1)]
    # A repeated row, a null id, an empty and a very long text, and extra columns named like the operators' results.
    rows += [rows[20], (None, "no id but some words of its own", "en", "s", 1), (204, "", None, "s", 1), (205, " ".join(f"long{rng.randrange(9000)}" for _ in range(30000)), "en", "s", 1)]
    sf = str(tmp_path)
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.withColumns({"lang_pred": F.lit("x"), "score": F.lit(2), "n_dropped": F.lit("y"), "n_shingles": F.lit(3), "n_tokens": F.lit(4)}).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        got = docs.collect()
        seen[name] = {r["doc_id"]: r for r in got}
        assert sum(r["doc_id"] == 20 for r in got) == 2 and {None, 205} <= set(seen[name])
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert set(range(40)) <= set(seen["language_id"]) and not {201, 202, 204} & set(seen["language_id"])
    assert [line in seen["line_dedup"][100 + k]["text"] for k in range(6)] == [False] * 5 + [True]
    assert 0 in seen["ngram_jaccard"] and 200 not in seen["ngram_jaccard"]
    assert 203 in seen["ngram_jaccard"] and 203 not in seen["decontaminate"]
    assert set(seen["sentencepiece"]) == set(seen["decontaminate"]) and all(r["n_tokens"] > 1 for r in seen["sentencepiece"].values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == set(seen["sentencepiece"])
    empty = tmp_path / "empty"
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
