"""One query for each operator, over the whole of its table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, encoding, fill_middle, language, lexical, mixing, neardup, ordermin, quality, secrets, token_counts, topk, training_order
from .common import documents, shared_path


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_decode(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), digests=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.in_order(mixing.mix(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 3).alias("first_position"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.written_order(documents(spark, sf_dir), shared_path(spark, "shards"), tokenizer("byte_bpe_50k.tiktoken"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(documents(spark, sf_dir))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.score(documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.restored(fill_middle.fill_in_middle(documents(spark, sf_dir)))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    length = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return rows.select("doc_id", "n", "form", length("prefix"), length("middle"), digest("output"), digest("restored"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir), rejecting=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_training_order, op3_quality, op4_order_minhash, op5_token_counts, op6_top_k, op7_secret_scan, op8_lm_scoring, op9_mixing,
        op10_near_duplicates, op11_fill_in_middle, op12_ranked_search, op13_language,
    )
}

ORACLES = {
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, text
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][place + 1] AS weight, [1.5, 1.0, 0.5][place + 1]::DOUBLE AS early, [0.5, 1.0, 1.5][place + 1]::DOUBLE AS late, 3 * source_size AS cap FROM s
), r AS (
  SELECT *, sum(source_size) OVER () AS everything, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER b, 0) AS caps_before, coalesce(sum(weight) OVER b, 0) AS weights_before
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, CAST(everything - caps_before AS DOUBLE) / (weights - weights_before) * weight > cap AS stopped FROM r
), l AS (
  SELECT CAST(any_value(everything) - coalesce(sum(cap) FILTER (stopped), 0) AS DOUBLE) / sum(weight) FILTER (NOT stopped) AS level FROM f
), t AS (
  SELECT source, source_size, early, late, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM f, l
), g AS (
  SELECT sum(target * early) AS d1, sum(target * ((late - early) / 2)) AS d2 FROM t
), c AS (
  SELECT d.*, t.source_size, t.target, t.early, t.late,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "begin",
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, greatest(0, least(size, CAST(floor(target - whole * source_size) AS BIGINT) - "begin")) AS more FROM c
), p AS (
  SELECT *, "begin" / target AS u FROM e
), q AS (
  SELECT *, CASE WHEN size > 0 AND whole + CAST(more > 0 AS INT) > 0 THEN 2 * u / (early + sqrt(early * early + 2 * (late - early) * u)) END AS moment FROM p
)
SELECT doc_id, size, source_size, target, CAST(whole * size + more AS BIGINT) AS taken,
       round(g.d1 * moment + g.d2 * moment * moment, 3) AS first_position
FROM q, g""",
    "op6_top_k": """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM x WHERE vec_id % 20 = 0) q JOIN x c ON q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM p QUALIFY rank <= 20""",
    "op10_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w
), u AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS sh FROM g
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (
  SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x
)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, c.component_id, g.doc_id = c.component_id AS kept
FROM g JOIN c ON g.doc_id = c.doc_id""",
    "op11_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), r AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS h FROM d
), f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""",
    "op12_ranked_search": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), d AS (
  SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM t WHERE len(terms) > 0
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(n) AS BIGINT) AS L FROM d
), p AS (
  SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL
), q AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(s.N) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term
), x AS (
  SELECT q.item_id, p.r, p.doc_id, CAST(sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.N) // s.L)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY q.item_id, p.r, p.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 20""",
}
