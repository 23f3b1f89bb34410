"""The queries ``opN_<name>`` over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat_format, chroma, decontaminate, language_id, line_dedup, lm_score, ngram_jaccard, prefix_trie, sentencepiece_bpe, sort_means, token_counts, toxicity, url_templates


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; every node has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from the folds other than 2 of 4."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs, _fold(4) != 2)
    held = docs.select("doc_id", (_fold(4) == 2).alias("held_out"), "text")
    return language_id.predict(held, model, carry=["doc_id", "held_out"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learnt from the labels of the folds other than 0 of 5."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), _fold(5) != 0)
    held = docs.select("doc_id", (_fold(5) == 0).alias("held_out"), "text")
    return toxicity.score(held, model, carry=["doc_id", "held_out"], passages=False)


def op3_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made of all vectors, fingerprinted; those with an id divisible by 100 are aligned with all."""
    media = chroma.sonified(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return chroma.align(media, F.col("rec") % 100 == 0).withColumnRenamed("rec", "vec_id")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document; learnt from the folds other than 1 of 5."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", (_fold(5) == 1).alias("held_out"), "text")
    return lm_score.score(docs, ~F.col("held_out"), carry=["doc_id", "held_out"])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, of its source field and of each line of its text."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = token_counts.count(docs, ["source", "text"], tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=["doc_id"])
    of = lambda field: F.aggregate(F.filter("sections", lambda s: s["field"] == field), F.lit(0), lambda a, s: a + s["tokens"]).cast("bigint")
    return counted.select("doc_id", "n_tokens", "n_crossing", of("source").alias("source_tokens"), of("text").alias("text_tokens"), F.transform("sections", lambda s: s["tokens"]).alias("section_tokens"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds the template's look-alikes, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    messages = chat_format.fold(chat_format.from_rows(rows.unionByName(added)))
    back = chat_format.read_back(chat_format.render(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 23) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five or more documents share."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are alike by 0.85 or more."""
    return ngram_jaccard.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, num=85, den=100)


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ends AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT ends.b, reach.root FROM reach JOIN ends ON ends.a = reach.doc_id
)
SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: digests of the ids and of the decoded text."""
    docs = _table(spark, sf_dir, "documents")
    return sentencepiece_bpe.encode(docs, tokenizer_path("piece_bpe_32k.model"), digest=True, carry=["doc_id"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with the edits and the stretch of words."""
    return decontaminate.matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 finite components in 40 clusters, after five rounds."""
    return sort_means.cluster(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", dims=64, clusters=40, rounds=5)


def _sort_means_sql(dims: int, clusters: int, rounds: int) -> str:
    """Every distance of every round."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS j, v FROM kept QUALIFY j < {clusters}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT k, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(j, (d, j)) AS j, min(d) AS d
  FROM (SELECT k, vec_id, kept.v AS v, j, list_sum(list_transform(range(1, {dims + 1}), lambda i: (kept.v[i] - c{r}.v[i]) * (kept.v[i] - c{r}.v[i]))) AS d FROM kept, c{r}) GROUP BY k
)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS MATERIALIZED (
  SELECT j, list(m ORDER BY i) AS v FROM (
    SELECT j, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM (SELECT j, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY j, i) GROUP BY j
), c{r + 1} AS MATERIALIZED (
  SELECT j, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (j)
)"""
            )
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (j)"""
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, rebuilt with the first turns of every hundredth."""
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END)) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id)
), heads AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos < c.h
), n_heads AS (
  SELECT c.conv_id, c.h, count(k.pos) AS n_head, count(k.pos) + greatest(any_value(c.n - c.h), 0) AS n_turns FROM convs c LEFT JOIN heads k USING (conv_id) GROUP BY ALL
), rebuilt AS (
  SELECT * FROM heads UNION ALL SELECT o.conv_id, o.pos - h + n_head, role, text FROM own o JOIN n_heads USING (conv_id) WHERE o.pos >= h
), paths AS (
  SELECT conv_id, pos + 1 AS depth, length(text) AS chars, n_turns,
    sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS key
  FROM rebuilt JOIN n_heads USING (conv_id)
), occ AS (
  SELECT *, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM paths UNION ALL SELECT conv_id, 0, 0, n_turns, '', NULL FROM n_heads
), nodes AS (
  SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n_turns = depth), '')) AS ends_sha256
  FROM occ GROUP BY key, depth
), children AS (
  SELECT parent AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), below AS (
  SELECT o.key, sum(n.saved) AS saved, count(*) FILTER (c.key IS NULL) AS leaves
  FROM nodes n JOIN occ o ON o.conv_id = n.conv_id AND o.depth <= n.depth LEFT JOIN children c ON c.key = n.key GROUP BY o.key
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children,
  b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN children c ON c.key = n.key JOIN below b ON b.key = n.key
"""


#: Rules of the url filter: the longest that fits wins.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op13_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page allowed or blocked by a rule, else by its path's template."""
    return url_templates.judge(_table(spark, sf_dir, "pages"), URL_RULES, carry=["page_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_toxicity": op2_toxicity,
        "op3_chroma": op3_chroma,
        "op4_lm_score": op4_lm_score,
        "op5_token_counts": op5_token_counts,
        "op6_chat_format": op6_chat_format,
        "op7_line_dedup": op7_line_dedup,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_decontaminate": op10_decontaminate,
        "op11_sort_means": op11_sort_means,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_url_templates": op13_url_templates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_chat_format": OP6_SQL,
        "op7_line_dedup": OP7_SQL,
        "op8_ngram_jaccard": OP8_SQL,
        "op11_sort_means": _sort_means_sql(64, 40, 5),
        "op12_prefix_trie": OP12_SQL,
    }
