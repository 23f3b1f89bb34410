"""Operators that map over texts: language, toxicity, token counts, pieces, chat, lines."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import bytes_np, chat_format, language_id, line_dedup, queries, sentencepiece_bpe, token_counts, toxicity

MODEL = queries.tokenizer_path("piece_bpe_32k.model")
ODD_TEXTS = [None, "", " ", "\n", "\n\n", "  a  b ", "A\tb\r\n c\x0b\x0c d", "é🤷 執▁▁x", "<s></s><unk><0x41>", "x" * 3000, ("wort " * 4000) + "ende", "a" + " " * 50 + "b", "\x00\x01", "ÀÉ Z"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", k) for k, t in enumerate(ODD_TEXTS)] + [(1, "", "en", 0), (None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score bigint")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# --- bytes


def test_words_and_hashes_match_python():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB \t\né.") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    seen = {}
    for lo, hi, data, offsets in bytes_np.chunks(pa.array(texts), 300):
        h, per, starts, ends = bytes_np.space_words(data, offsets)
        at = 0
        for row, n in enumerate(per):
            words = texts[lo + row].translate({c: c + 32 for c in range(65, 91)}).split()
            assert n == len(words)
            for w in words:
                assert seen.setdefault(w, h[at]) == h[at]
                at += 1
    assert len(set(seen.values())) == len(seen)


def test_chunks_take_slices_and_long_rows():
    column = pa.array(["aa", None, "b" * 50, "c"]).slice(1)
    got = [(lo, hi, data.tobytes()) for lo, hi, data, _ in bytes_np.chunks(column, 10)]
    assert b"".join(x[2] for x in got) == b"b" * 50 + b"c" and got[0][0] == 0 and got[-1][1] == 3


# --- sentencepiece


def test_pieces_equal_the_library(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sentencepiece_bpe.encode(odd.select("doc_id", "text"), MODEL, carry=["doc_id"]).collect()
    assert len(got) == odd.count()
    wanted = sorted((r["doc_id"] is None, r["doc_id"] or 0, sp.encode(r["text"] or "") + [2]) for r in odd.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in got) == wanted
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["decoded"] == sp.decode(r["ids"])


def test_pieces_of_random_texts_and_runs_of_spaces():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = sentencepiece_bpe.Encoder(sentencepiece_bpe.PieceModel(MODEL), keep=500)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeh   \n▁éè.,<>01テ文🤷\tTH") for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    texts += ["a" + " " * k + "b" for k in range(120)] + [" " * k for k in range(120)]
    for t in texts:
        ids = sp.encode(t) + [2]
        assert encoder.encode(t) == (" ".join(map(str, ids)), sp.decode(ids)), t


def test_pieces_digest_and_empty_table(spark, odd, empty):
    r = sentencepiece_bpe.encode(odd.where("doc_id = 5"), MODEL, digest=True, carry=["doc_id"]).first()
    full = sentencepiece_bpe.encode(odd.where("doc_id = 5"), MODEL, carry=["doc_id"]).first()
    assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, full["ids"])).encode()).hexdigest()
    assert r["decoded_sha256"] == hashlib.sha256(full["decoded"].encode()).hexdigest()
    assert sentencepiece_bpe.encode(empty, MODEL).count() == 0


# --- language


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    words = {"en": ["the", "and", "thing", "wether"], "de": ["und", "schön", "die", "nicht"], "fr": ["être", "que", "les", "vous"], "es": ["ción", "está", "los", "niño"]}
    rows = [(k, " ".join(rng.choice(words[code]) for _ in range(rng.randrange(3, 30))), code) for k, code in enumerate(sorted(words) * 40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_languages_on_held_out_rows(labelled):
    model = language_id.train(labelled, F.col("doc_id") % 3 != 0, sample=120)
    assert model.families == ["germanic", "romance"] and len(model.family_pairs) == 1 and len(model.lang_pairs) == 2
    got = language_id.predict(labelled.where("doc_id % 3 = 0"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_survive_a_text_that_is_repeated(labelled):
    """Copies of a text take no other text's or language's place in the sample, whichever text it is."""
    texts = labelled.where("lang = 'en' and doc_id % 3 != 0")
    first = texts.orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 30))).limit(1)  # the one that is drawn first
    many = labelled.unionByName(first.crossJoin(labelled.sparkSession.range(5000)).select("doc_id", "text", "lang"))
    plain, model = (language_id.train(df, F.col("doc_id") % 3 != 0, sample=120) for df in (labelled, many))
    assert model.langs == plain.langs == ["de", "en", "es", "fr"]
    got = language_id.predict(labelled.where("doc_id % 3 = 0"), model).collect()
    for code in model.langs:
        own = [r for r in got if r["lang"] == code]
        assert sum(r["lang_pred"] == code for r in own) / len(own) > 0.9


def test_languages_are_bounded_to_those_of_most_texts(labelled, spark):
    rare = spark.createDataFrame([(1000 + k, f"text {k}", f"x{k}") for k in range(6)], "doc_id bigint, text string, lang string")
    model = language_id.train(labelled.unionByName(rare), F.lit(True), sample=120, languages=4)
    assert model.langs == ["de", "en", "es", "fr"]


def test_language_of_odd_texts(labelled, odd, empty):
    model = language_id.train(labelled, F.lit(True), sample=120)
    got = {r["doc_id"]: r for r in language_id.predict(odd, model, carry=["doc_id"]).collect()}
    for k, t in enumerate(ODD_TEXTS):
        assert (got[k]["lang_pred"] == "und") == (not any(map(str.isalpha, t or ""))), t
    assert got[0]["score"] == 0.0 and language_id.predict(empty, model).count() == 0
    with pytest.raises(ValueError):
        language_id.train(labelled.where("false"), F.lit(True))
    one = language_id.train(labelled.where("lang = 'de'"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(labelled.limit(3), one).collect()} == {"de"}


def test_language_score_does_not_depend_on_neighbours(labelled):
    model = language_id.train(labelled, F.lit(True), sample=120)
    texts = [r["text"] for r in labelled.limit(30).collect()]
    alone = np.concatenate([language_id.scores(model, d, o) for t in texts for _, _, d, o in bytes_np.chunks(pa.array([t]))])
    together = np.concatenate([language_id.scores(model, d, o) for _, _, d, o in bytes_np.chunks(pa.array(texts))])
    assert np.allclose(alone, together)


# --- toxicity


def _all_maximal(values):
    """All maximal segments by the definition's recursion: the best segment, then both sides of it."""
    out = []

    def split(lo, hi):
        best, at = 0.0, None
        for i in range(lo, hi):
            s = 0.0
            for j in range(i, hi):
                s += values[j]
                if s > best + 1e-12:
                    best, at = s, (i, j + 1)
        if at:
            split(lo, at[0])
            out.append((at[0], at[1], best))
            split(at[1], hi)

    split(0, len(values))
    return out


def test_segments_are_all_maximal_ones():
    rng = random.Random(6)
    for _ in range(300):
        v = np.array([rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randrange(0, 16))])
        got = toxicity.segments(v)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in _all_maximal(v)]
        assert all(abs(s - v[a:b].sum()) < 1e-9 for a, b, s in got)


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng = random.Random(11)
    plain = [f"wd{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        bad = k % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["scum", "idiot", "moron"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    return docs, marks, toxicity.train(docs, marks, F.col("doc_id") % 3 != 0)


def test_toxic_texts_on_held_out_rows(toxic_model):
    docs, marks, model = toxic_model
    got = toxicity.score(docs.where("doc_id % 3 = 0"), model).join(marks, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.97
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["score"] >= 0.5) == bool(r["predicted"])
        for p in r["passages"]:
            assert any(w in r["text"].encode()[p["start"] : p["end"]].decode() for w in ("scum", "idiot", "moron"))


def test_toxicity_of_odd_texts(toxic_model, odd, empty, spark):
    model = toxic_model[2]
    got = toxicity.score(odd, model, carry=["doc_id"]).collect()
    assert len(got) == odd.count() and len({r["score"] for r in got}) == 1 and got[0]["passages"] == []
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(odd, spark.createDataFrame([], "doc_id bigint, toxic int"), F.lit(True))
    assert all(r["predicted"] == 0 for r in toxicity.score(odd, nothing).collect())


def test_toxicity_does_not_depend_on_the_rows_before(toxic_model, spark):
    model = toxic_model[2]
    texts = ["scum"] * 3 + ["idiot wd1 idiot"] * 3 + ["moron moron"] * 2
    _, _, data, offsets = next(bytes_np.chunks(pa.array(texts)))
    total = toxicity.evidence(model, data, offsets)[0].tolist()
    alone = [toxicity.evidence(model, *next(bytes_np.chunks(pa.array([t])))[2:])[0][0] for t in texts]
    assert total == alone and min(alone) > 0
    # A text of one word has no neighbours, whatever the rows beside it hold.
    rows = [x for k in range(6) for x in (("scum", True), (f"wd{k}", False))]
    toxic = toxicity._counts(spark.createDataFrame(rows, "text string, toxic boolean").coalesce(1), 20)[1]
    assert 0 < toxic.max() < 1.1


def test_score_by_brute_force(toxic_model):
    """Evidence and score of every text from the model's tables, word by word, with the segments by their definition."""
    docs, _, model = toxic_model
    assert model.decay > 0 and 0 < model.scale < 1
    for r in toxicity.score(docs.where("doc_id % 40 = 0"), model).collect():
        words = re.findall(r"[a-z0-9]+", r["text"].lower())
        values, before = [], None
        for word in words:
            raw = np.frombuffer(word.encode(), np.uint8)
            best = max(float(model.score[b[0]]) for b in toxicity.buckets(raw, np.array([0]), np.array([len(raw)]), model.bits))
            values.append(best if best > 0 and word != before else model.base)
            before = word
        chances = [-math.expm1(-model.scale * len(words) * math.exp(-model.decay * s)) for _, _, s in _all_maximal(values)]
        chances = [p for p in chances if p <= toxicity.SIGNIFICANT]
        total = -sum(map(math.log, chances))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-(model.intercept + model.slope * math.log1p(total)))), rel_tol=1e-5)
        assert len(r["passages"]) == len(chances)


def test_scale_of_the_law_is_that_of_clean_texts(spark):
    """Where a toxic word occurs in clean texts by chance, a lone one is no surprise, and several together are."""
    rng = random.Random(3)
    plain = [f"wd{k}" for k in range(50)]
    rows, labels = [], []
    for k in range(900):
        words = [rng.choice(plain) for _ in range(60)]
        if k % 3 == 0:
            words[20:20] = [rng.choice(["scum", "moron", "idiot"]) for _ in range(4)]
        elif k % 15 == 1:
            words[5:5] = [rng.choice(["scum", "moron", "idiot"])]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.lit(True))
    asked = spark.createDataFrame([(0, " ".join(["scum", *plain])), (1, " ".join([*plain, "scum", "idiot", "moron", "scum"]))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in toxicity.score(asked, model).collect()}
    assert got[0]["predicted"] == 0 and got[1]["predicted"] == 1 and got[0]["score"] < got[1]["score"]


def test_law_holds_on_clean_texts_of_other_rows(spark):
    """Of clean texts that nothing was learnt from, about as many exceed a chance as the chance says: over three seeds."""
    seen = []
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        plain, bad = [f"wd{k}" for k in range(300)], [f"scum{k}" for k in range(40)]
        rows = []
        for k in range(2400):
            words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
            for _ in range(rng.choice([3, 5]) if k % 6 == 0 else rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
            rows.append((k, " ".join(words), int(k % 6 == 0)))
        df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
        model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.col("doc_id") % 5 > 1)
        held = [text for k, text, label in rows if k % 5 <= 1 and not label]
        for _, _, data, offsets in bytes_np.chunks(pa.array(held)):
            per_row, found = toxicity._passages(model, data, offsets)
            seen += [min((-math.expm1(-model.scale * n * math.exp(-model.decay * s)) for _, _, s in row), default=1.0) for n, row in zip(per_row.tolist(), found)]
    assert sum(p <= 0.05 for p in seen) / len(seen) <= 0.07
    assert sum(p <= 0.01 for p in seen) / len(seen) <= 0.02


def test_law_is_found_again():
    """Best segments drawn from the law itself give back its decay and scale."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(20, 400, 40000)
    best = np.maximum(np.round((np.log(0.02 * sizes) - np.log(rng.exponential(size=len(sizes)))) / 1.3, 3), 0)
    values, at = np.unique(best, return_inverse=True)
    decay, scale = toxicity.fit_law(values, np.bincount(at).astype(float), np.bincount(at, weights=sizes), 3.0)
    assert math.isclose(decay, 1.3, rel_tol=0.05) and math.isclose(scale, 0.02, rel_tol=0.25)


# --- very long texts


def test_hashes_of_long_arrays_are_those_of_their_parts():
    """Words, very long words and unordered spans of an array beyond the size that is summed at once."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 5 * bytes_np.CHUNK_BYTES, dtype=np.uint8)
    data[rng.integers(0, len(data), 50_000)] = 32
    data[bytes_np.CHUNK_BYTES // 2 : 4 * bytes_np.CHUNK_BYTES] = 98
    starts, ends, _ = bytes_np.spans(data != 32, np.array([0, len(data)]))
    got = bytes_np.SpanHasher(data)(starts, ends)
    shuffled = rng.permutation(len(starts))
    assert (bytes_np.SpanHasher(data)(starts[shuffled], ends[shuffled]) == got[shuffled]).all()
    for k in [0, len(starts) - 1, *rng.integers(0, len(starts), 200)]:
        if ends[k] - starts[k] <= 2 * bytes_np.CHUNK_BYTES:
            assert bytes_np.span_hashes(data[starts[k] : ends[k]], np.array([0]), np.array([ends[k] - starts[k]]))[0] == got[k]
    tail = np.full(3 * bytes_np.CHUNK_BYTES, 98, np.uint8)
    assert bytes_np.span_hashes(tail, np.array([0]), np.array([len(tail)]))[0] == bytes_np.span_hashes(np.append(tail, np.uint8(32)), np.array([0]), np.array([len(tail)]))[0]


def test_memory_of_a_text_of_fifty_megabytes():
    """Finding and hashing the words of one text of 50 MB takes at most sixteen times its size."""
    import tracemalloc

    column = pa.array(["some words of a long text " * 2_000_000], pa.large_string())
    for _, _, data, offsets in bytes_np.chunks(column):
        tracemalloc.start()
        words, per_row, starts, _ = bytes_np.space_words(data, offsets)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert per_row.tolist() == [12_000_000] and len(np.unique(words)) == 6
    assert peak <= 16 * len(data)


# --- token counts


def test_attribution_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.randrange(1, 30)
        cuts = sorted(rng.sample(range(1, size + 1), min(size, rng.randrange(0, 6))))
        tokens = [(a, b) for a, b in zip([0, *cuts], [*cuts, size]) if b > a]
        borders = np.array(sorted({0, *rng.sample(range(size), min(size, rng.randrange(0, 5)))}))
        first, stop = np.array([a for a, _ in tokens]), np.array([b for _, b in tokens])
        own, crossing = token_counts.attribute(first, stop, borders)
        ends = [*borders[1:], 10**9]
        for (a, b), section, cross in zip(tokens, own, crossing):
            shares = [max(0, min(b, e) - max(a, s)) for s, e in zip(borders, ends)]
            assert section == shares.index(max(shares)) and cross == (sum(x > 0 for x in shares) > 1)


def test_token_counts_are_kept_whole(spark, odd, empty):
    import public_tokenizers
    import tiktoken  # noqa: F401

    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    codec, _ = token_counts.encoding(path, public_tokenizers.PATTERN)
    rows = token_counts.count(odd, ["lang", "text"], path, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd.count()
    for r in rows:
        whole = (r["lang"] or "") + "\n" + (r["text"] or "")
        assert r["n_tokens"] == len(codec.encode_ordinary(whole)) == sum(s["tokens"] for s in r["sections"])
        assert len(r["sections"]) == 1 + (r["text"] or "").count("\n") + 1
        for s in r["sections"][1:]:
            assert s["start"] == 0 or whole[s["start"] - 1] == "\n"
    assert token_counts.count(empty, ["text"], path, public_tokenizers.PATTERN).count() == 0


# --- chat


def test_chat_folds_deltas_edits_and_regenerations(spark):
    events = spark.createDataFrame(
        [
            (1, 1, 1, "message", "user", "hi"),
            (1, 2, 2, "message", "assistant", ""),
            (1, 3, 2, "delta", "assistant", "he"),
            (1, 4, 2, "delta", None, "llo"),
            (1, 5, 3, "message", "user", "gone"),
            (1, 6, 2, "regenerate", None, ""),
            (1, 7, 2, "delta", None, "again"),
            (1, 8, 3, "message", "user", "<|end|> \\ <|turn|>"),
            (1, 9, 3, "delta", None, "!"),
            (2, 1, 1, "message", None, None),
            (None, 1, 1, "message", "user", "x"),
        ],
        "conv_id bigint, seq bigint, message bigint, kind string, role string, text string",
    )
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.render(chat_format.fold(events))).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", "hi"), ("assistant", "again"), ("user", "<|end|> \\ <|turn|>!")]
    assert back[1]["loss_texts"] == ["again"]
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("", "")] and back[None]["loss_texts"] == []
    with pytest.raises(Exception, match="unknown kind"):
        chat_format.fold(events.withColumn("kind", F.lit("typo"))).collect()
    assert chat_format.render(chat_format.fold(events.limit(0))).count() == 0


def test_chat_messages_without_an_id_come_first(spark):
    """A null id is before all others: edits of other messages leave it, an edit of it takes back all others."""
    log = [(1, 1, None, "message", "user", "no id"), (1, 2, 1, "message", "user", "a"), (1, 3, 2, "message", "assistant", "gone"), (1, 4, 1, "edit", None, "b")]
    log += [(2, 1, None, "message", "user", "x"), (2, 2, 1, "message", "assistant", "gone"), (2, 3, None, "edit", None, "y"), (2, 4, 2, "message", "assistant", "z")]
    df = spark.createDataFrame(log, "conv_id bigint, seq bigint, message bigint, kind string, role string, text string").withColumn("at", F.lit("x"))
    got = [(r.conv_id, r.ordinal, r.role, r.text) for r in chat_format.fold(df).orderBy("conv_id", "ordinal").collect()]
    assert got == [(1, 1, "user", "no id"), (1, 2, "user", "b"), (2, 1, "user", "y"), (2, 2, "assistant", "z")]


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(12)
    rows = [(c, t, rng.choice(["user", "assistant", "<|text|>"]), "".join(rng.choice(["<", "|", ">", "\\", "<|end|>", "<|text|>", "é", "\n", "a", "$1"]) for _ in range(rng.randrange(0, 9)))) for c in range(40) for t in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for r in chat_format.read_back(chat_format.render(chat_format.fold(chat_format.from_rows(df)))).collect():
        own = [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert r["loss_texts"] == [t for role, t in own if role == "assistant"]


# --- lines


def _dedup(rows, least=5, chars=40):
    held = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < least or max(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_shared_lines_by_brute_force(spark):
    rng = random.Random(21)
    pool = [("Line %d é " % k) * rng.choice([1, 4, 7]) for k in range(12)]
    rows = [(d, "\n".join(rng.choice(["", "  ", "\t"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) for _ in range(rng.randrange(0, 8)))) for d in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (5, rows[5][1])]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id bigint, text string, n_lines bigint")
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup(df, batches=3).collect())
    assert got == _dedup(rows) and any(x[2] for x in got)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_runs_keep_levels_and_find_unseen_lines(spark):
    line = "this line is long enough to be looked at, surely"
    batch = lambda ids: line_dedup.line_facts(spark.createDataFrame([(d, line if d < 3 else line + str(d)) for d in ids], "doc_id bigint, text string"))
    runs = line_dedup.LineRuns(spark, fanout=2)
    assert runs.unseen(batch([1])).count() == 1
    runs.add(batch([1]))
    assert runs.unseen(batch([2, 4])).count() == 1
    runs.add(batch([2, 4]))
    # The second batch added the one key that no run held; what it has of the other is beside the runs.
    assert sum(run.count() for run in runs.runs()) == 2 and [(r["n_docs"], r["keeper"]) for r in runs.repeats[0].collect()] == [(1, 2)]
    runs.add(batch([5]))
    assert [len(x) for x in runs.levels] == [1, 1]
    got = sorted((r["n_docs"], r["keeper"]) for r in runs.entries().collect())
    assert got == [(1, 4), (1, 5), (2, 2)]
