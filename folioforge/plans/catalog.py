"""The library's registered queries over whole tables, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structured, text
from ..operators import chunking, concepts, dialogue, facts, generate, index, retrieval
from ..sources import readers
from ..storage import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_documents(expr: Callable, name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, "documents").select("doc_id", expr(F.col("text")).alias(name))


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, chr(160), ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
#: Sentences: a mark after . ! ? with white space behind, and at blank lines; then split, strip and drop blanks.
_SENT = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n{2,}', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_LINE_SENT = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n+', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_RAG = "list_filter(regexp_extract_all(lower({}), '[a-zа-яё0-9]+'), lambda x: len(x) > 1)"
_LOW = r"""(len(trim({0}, E' \t\n\r')) < 120 OR len(list_filter(string_split({0}, chr(10)), lambda x: regexp_matches(x, '\.{{4,}}\s*\d{{1,3}}\s*$'))) >= 2
  OR len(list_filter(string_split({0}, chr(10)), lambda x: regexp_matches(x, '\.{{4,}}\s*\d{{1,3}}\s*$'))) + len(list_filter(string_split({0}, chr(10)), lambda x: regexp_full_match(trim(x), '\d{{1,3}}')))
   >= greatest(3, len(list_filter(string_split({0}, chr(10)), lambda x: trim(x) <> '')) // 2))"""
_SIG = r"substr(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), 1, 800)"


def _substitution_sql(x: str = "text") -> str:
    """Tokens with three characters from 0x10 to 0x4F (without blanks) and more, 55 % of them, by place in the alphabet: its letters but one."""
    old = " || ".join(f"chr({c})" for c in [*range(0x10, 0x20), *range(0x21, 0x50)])
    new = "'АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮабвгдежзийклмнопрстуфхцчшщъыьэюя'"
    hits = r"len(regexp_replace(t, '[^\x10-\x1f\x21-\x4f]', '', 'g'))"
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\S+|\s+'), lambda t: CASE WHEN contains(lower(t), 'http') OR contains(t, '/') OR {hits} < 3 OR {hits} / len(t) < 0.55 THEN t ELSE translate(t, {old}, {new}) END), '')"


#: Hyphens at line ends, spaced letters (parts at even places between the marks), blanks before punctuation.
_FIXED = r"""regexp_replace(array_to_string(list_transform(string_split_regex(regexp_replace(regexp_replace({}, '([A-Za-zА-Яа-яЁё])-\n([A-Za-zА-Яа-яЁё])', '\1\2', 'g'),
  '(^|\s)([A-Za-zА-Яа-яЁё](?:\s+[A-Za-zА-Яа-яЁё]){{2,}})(\s|$)', '\1' || chr(57344) || '\2' || chr(57345) || '\3', 'g'), '[' || chr(57344) || chr(57345) || ']'),
  lambda part, i: CASE WHEN i % 2 = 0 THEN replace(part, ' ', '') ELSE part END), ''), '\s+([,.;:!?])', '\1', 'g')"""
QUERIES["normalize_whitespace"] = on_documents(text.normalize_whitespace, "normalized")
ORACLES["normalize_whitespace"] = f"SELECT doc_id, {_NORM.format('text')} AS normalized FROM documents"
QUERIES["decode_substitution"] = on_documents(text.decode_substitution, "decoded")
ORACLES["decode_substitution"] = f"SELECT doc_id, {_substitution_sql()} AS decoded FROM documents"
QUERIES["fix_pdf_artifacts"] = on_documents(text.fix_pdf_artifacts, "fixed")
ORACLES["fix_pdf_artifacts"] = f"SELECT doc_id, {_FIXED.format('text')} AS fixed FROM documents"
QUERIES["normalize_text"] = on_documents(text.normalize_text, "normalized")
ORACLES["normalize_text"] = f"SELECT doc_id, {_NORM.format('fixed')} AS normalized FROM (SELECT doc_id, {_FIXED.format('decoded')} AS fixed FROM (SELECT doc_id, {_substitution_sql()} AS decoded FROM documents))"
QUERIES["shorten"] = on_documents(text.shorten, "short")
ORACLES["shorten"] = f"SELECT doc_id, CASE WHEN len(s) <= 180 THEN s ELSE rtrim(substr(s, 1, 177)) || '...' END AS short FROM (SELECT doc_id, {SQUEEZE.format('text')} AS s FROM documents)"
QUERIES["short_text"] = on_documents(lambda c: text.short_text(c, 64), "short")
ORACLES["short_text"] = f"SELECT doc_id, CASE WHEN len(s) <= 64 THEN s WHEN rtrim(regexp_extract(substr(s, 1, 64), '^(.*) [^ ]*$', 1)) = '' THEN substr(s, 1, 64) ELSE rtrim(regexp_extract(substr(s, 1, 64), '^(.*) [^ ]*$', 1)) END AS short FROM (SELECT doc_id, {SQUEEZE.format('text')} AS s FROM documents)"
QUERIES["low_signal_filter"] = on_documents(text.low_signal, "low_signal")
ORACLES["low_signal_filter"] = f"SELECT doc_id, {_LOW.format('text')} AS low_signal FROM documents"
QUERIES["safe_filename"] = on_documents(text.safe_filename, "file")
ORACLES["safe_filename"] = "SELECT doc_id, CASE WHEN f = '' THEN 'presentation' ELSE f END AS file FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[^a-zA-Z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS f FROM documents)"
_CLEAN_SOURCE = SQUEEZE.format(r"replace(regexp_replace(text, '[-‐‑]\s*\n\s*', '', 'g'), chr(10), ' ')")
for _border in ("([.!?])([А-ЯA-Z])", "([a-zа-я])([A-ZА-Я])", "([A-Za-z])([А-Яа-я])", "([А-Яа-я])([A-Za-z])"):
    _CLEAN_SOURCE = rf"regexp_replace({_CLEAN_SOURCE}, '{_border}', '\1 \2', 'g')"
_CLEAN_SOURCE = rf"regexp_replace({_CLEAN_SOURCE}, '(^|[^\pL\p{{Mn}}\p{{Nd}}\p{{Pc}}])[0-9]+\s*$', '\1')"
QUERIES["dialogue_prepare"] = on_documents(text.prepared_source, "prepared")
ORACLES["dialogue_prepare"] = rf"""
WITH c AS (SELECT doc_id, {_CLEAN_SOURCE} AS clean FROM documents
), p AS (SELECT doc_id, clean, list_slice(list_filter(list_transform(string_split(regexp_replace(clean, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(x) >= 25 AND NOT regexp_full_match(x, '[^\pL]+')), 1, 18) AS parts FROM c)
SELECT doc_id, substr(CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' ') ELSE clean END, 1, 3500) AS prepared FROM p"""
#: Between word characters there is no border; RE2 has none beyond ASCII, so runs of word characters are read whole.
_WORDS = r"\pL\p{{Mn}}\p{{Mc}}\p{{Nd}}\p{{Nl}}\p{{Pc}}"
_OCR = r"regexp_replace(regexp_replace({}, '[^\S\r\n]+', ' ', 'g'), '(?m)^.*\.{{4,}}\s*[0-9]+\s*$', '', 'g')"
_CLEAN = rf"array_to_string(list_transform(regexp_extract_all({_OCR}, '[{_WORDS}]+|[^{_WORDS}]+'), lambda w: CASE WHEN regexp_full_match(w, '(?i)[а-яёa-z]{{{{1,3}}}}[эьъ][а-яёa-z]{{{{0,3}}}}') THEN ' ' ELSE w END), '')"
QUERIES["clean_ocr_noise"] = on_documents(text.clean_ocr_noise, "clean")
ORACLES["clean_ocr_noise"] = f"SELECT doc_id, {_CLEAN.format('text')} AS clean FROM documents"


@query(f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
def split_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence"))


_CHUNKS = rf"""
WITH s AS (SELECT doc_id, source, {_SENT} AS ss FROM documents), f AS (
  SELECT doc_id, source, list_reduce(list_transform(ss, lambda x: {{'done': []::VARCHAR[], 'held': x}}), lambda a, b: CASE
      WHEN len(b.held) > 900 THEN {{'done': list_concat(CASE WHEN a.held <> '' THEN list_append(a.done, a.held) ELSE a.done END,
        list_filter(list_transform(range(0, len(b.held), 720), lambda i: regexp_replace(substr(b.held, CAST(i + 1 AS BIGINT), 900), '^\s+|\s+$', '', 'g')), lambda w: w <> '')), 'held': ''}}
      WHEN a.held = '' THEN {{'done': a.done, 'held': b.held}}
      WHEN len(a.held) + 1 + len(b.held) <= 900 THEN {{'done': a.done, 'held': a.held || ' ' || b.held}}
      ELSE {{'done': list_append(a.done, a.held), 'held': regexp_replace(regexp_replace(right(a.held, 180), '^\s+|\s+$', '', 'g') || ' ' || b.held, '^\s+|\s+$', '', 'g')}} END,
    {{'done': []::VARCHAR[], 'held': ''}}) AS r
  FROM s WHERE len(ss) > 0
), c AS (
  SELECT doc_id, source, CASE WHEN r.held <> '' THEN list_append(r.done, r.held) ELSE r.done END AS cs FROM f
), chunks AS (
  SELECT doc_id, source, CAST(generate_subscripts(cs, 1) - 1 AS INT) AS chunk_index, unnest(cs) AS text FROM c
)"""


#: Sentences of squeezed text; those of eight characters and more without quotes at their ends are the lines of a dialogue.
_DIALOGUE = rf"""WITH q AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({SQUEEZE.format('text')}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents
), p AS (SELECT doc_id, len(ss) AS n_sentences, list_filter(list_transform(ss, lambda x: trim(x, ' "''')), lambda x: len(x) >= 8) AS parts FROM q)"""
_SPOKEN = r"""regexp_replace(part, '[^\pL\p{Mn}\p{Mc}\p{Me}\p{Nd}\p{Nl}\p{Pc}\s.,!?;:()"''«»—-]', ' ', 'g')"""
QUERIES["dialogue_coerce"] = on_documents(dialogue.coerced, "dialogue")
ORACLES["dialogue_coerce"] = (
    _DIALOGUE + " SELECT doc_id, CASE WHEN n_sentences >= 6 AND len(parts) >= 6 THEN array_to_string(list_transform(parts, lambda x, i: CASE WHEN i % 2 = 1 THEN 'Ведущий 1: ' ELSE 'Ведущий 2: ' END || x), chr(10)) ELSE '' END AS dialogue FROM p"
)
QUERIES["tts_text"] = on_documents(text.tts_text, "spoken")
ORACLES["tts_text"] = f"SELECT doc_id, substr({SQUEEZE.format(_SPOKEN)}, 1, 280) AS spoken FROM (SELECT doc_id, text AS part FROM documents)"


def chunks(spark, d) -> DataFrame:
    return chunking.build_chunks(table(spark, d, "documents"), "doc_id", "source")


@query(_CHUNKS + " SELECT CAST(doc_id AS VARCHAR) AS source_path, source AS source_name, chunk_index, text FROM chunks")
def chunk_documents(spark, d):
    return chunks(spark, d).drop("chunk_id")


@query(
    _CHUNKS + r""", h AS (
  SELECT doc_id, chunk_index, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || ':' || chunk_index || ':' || text)) AS h FROM chunks)
SELECT CAST(doc_id AS VARCHAR) AS source_path, chunk_index, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM h"""
)
def chunk_ids(spark, d):
    return chunks(spark, d).select("source_path", "chunk_index", "chunk_id")


@query(_CHUNKS + " SELECT source AS source_name, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, max(len(text)) AS longest FROM chunks GROUP BY source")
def chunk_stats(spark, d):
    return chunks(spark, d).groupBy("source_name").agg(F.count("*").alias("n_chunks"), F.countDistinct("source_path").alias("n_docs"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies, sig FROM (SELECT doc_id, {_SIG.format('text')} AS sig FROM documents) WHERE sig <> '' GROUP BY sig")
def text_signature_dedupe(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.signature(F.col("text")).alias("sig")).filter("sig <> ''")
    return rows.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"SELECT t AS token, count(*) AS n FROM (SELECT unnest({_RAG.format('text')}) AS t FROM documents) GROUP BY t")
def token_frequency(spark, d):
    return table(spark, d, "documents").select(F.explode(text.rag_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def indexed(spark, d) -> DataFrame:
    """Documents as chunks with their vectors."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    return docs.join(vectors, docs.doc_id == vectors.vec_id).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_name"), F.lit(0).alias("chunk_index"), "text", "embedding")


def asked(spark, d) -> DataFrame:
    """Every text of the benchmark, with the vector of its number, as a query."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector"))
    return table(spark, d, "benchmark").join(vectors, "item_id").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "query_vector")


_HYBRID = rf"""
WITH idx AS (
  SELECT d.doc_id AS chunk_id, d.source AS source_name, d.text, e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id
), q AS (
  SELECT b.item_id AS query_id, e.embedding AS v, b.text AS qt FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id
), near AS (
  SELECT query_id, chunk_id, source_name, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 9) AS dense_score_raw FROM idx, q
), best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score_raw DESC, chunk_id) AS cand_pos FROM near QUALIFY cand_pos <= 40
), top AS (
  SELECT best.*, idx.text FROM best JOIN idx USING (chunk_id)
), u AS (
  SELECT *, {_RAG.format('text')} AS toks FROM top WHERE regexp_replace(text, '\s+', '', 'g') <> '' AND NOT {_LOW.format('text')}
), st AS (SELECT query_id, count(*) AS n, avg(len(toks)) AS ml FROM u GROUP BY query_id
), tf AS (SELECT query_id, cand_pos, tok, count(*) AS tf FROM (SELECT query_id, cand_pos, unnest(toks) AS tok FROM u) GROUP BY ALL
), idf AS (SELECT query_id, tok, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN st USING (query_id) GROUP BY query_id, tok, n
), idf2 AS (SELECT query_id, tok, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY query_id) ELSE raw END AS idf FROM idf
), qt AS (SELECT query_id, tok, count(*) AS times FROM (SELECT query_id, unnest({_RAG.format('qt')}) AS tok FROM q) GROUP BY ALL
), sc AS (
  SELECT tf.query_id, tf.cand_pos, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(u.toks) / ml))) AS found
  FROM tf JOIN qt USING (query_id, tok) JOIN idf2 USING (query_id, tok) JOIN u USING (query_id, cand_pos) JOIN st USING (query_id) GROUP BY ALL
), b AS (
  SELECT u.*, round(coalesce(found, 0), 9) AS bm25_raw FROM u LEFT JOIN sc USING (query_id, cand_pos)
), m AS (
  SELECT *, CASE WHEN max(dense_score_raw) OVER w - min(dense_score_raw) OVER w < 1e-12 THEN 0 ELSE (dense_score_raw - min(dense_score_raw) OVER w) / (max(dense_score_raw) OVER w - min(dense_score_raw) OVER w) END AS dn,
            CASE WHEN max(bm25_raw) OVER w - min(bm25_raw) OVER w < 1e-12 THEN 0 ELSE (bm25_raw - min(bm25_raw) OVER w) / (max(bm25_raw) OVER w - min(bm25_raw) OVER w) END AS bn FROM b WINDOW w AS (PARTITION BY query_id)
), h AS (SELECT *, round(0.7 * dn + (1 - 0.7) * bn, 9) AS score, {_SIG.format('text')} AS sig FROM m
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, sig ORDER BY score DESC, cand_pos) AS nth FROM h WHERE score >= 0.2 AND sig <> ''
), f AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_pos) AS INT) AS rank FROM r WHERE nth = 1 QUALIFY rank <= {{k}}
)"""
_TOP5, _TOP40 = _HYBRID.replace("{k}", "5"), _HYBRID.replace("{k}", "40")


@query(_TOP5 + " SELECT query_id, chunk_id, CAST(cand_pos AS INT) AS cand_pos, dense_score_raw AS dense FROM best")
def cosine_topk(spark, d):
    return retrieval.dense_candidates(indexed(spark, d), asked(spark, d)).select("query_id", "chunk_id", "cand_pos", F.col("dense_score_raw").alias("dense"))


@query(_TOP5 + " SELECT query_id, chunk_id, dense_score_raw AS dense FROM near WHERE source_name = 'src1' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense_score_raw DESC, chunk_id) <= 40")
def cosine_topk_filtered(spark, d):
    return retrieval.dense_candidates(indexed(spark, d), asked(spark, d), source_name="src1").select("query_id", "chunk_id", F.col("dense_score_raw").alias("dense"))


@query(_TOP5 + " SELECT query_id, chunk_id, bm25_raw AS bm25 FROM b")
def bm25_scores(spark, d):
    rows = retrieval.usable(retrieval.dense_candidates(indexed(spark, d), asked(spark, d)))
    return retrieval.bm25(rows).select("query_id", "chunk_id", F.col("bm25_raw").alias("bm25"))


@query(_TOP5 + " SELECT query_id, rank, chunk_id, source_name, score, round(dn, 6) AS dense_score, round(bn, 6) AS bm25_score FROM f")
def hybrid_retrieve(spark, d):
    out = retrieval.retrieve(indexed(spark, d), asked(spark, d))
    return out.select("query_id", "rank", "chunk_id", "source_name", "score", *(F.round(c, 6).alias(c) for c in ("dense_score", "bm25_score")))


@query(_TOP5 + " SELECT query_id, string_agg('[' || source_name || ' chunk=0]' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM f GROUP BY query_id")
def build_context(spark, d):
    return retrieval.context(retrieval.retrieve(indexed(spark, d), asked(spark, d)))


@query(
    _TOP5 + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_pos) - 1 AS i FROM h
), g AS (SELECT *, CASE WHEN i % 3 <> 0 OR i > 60 THEN 0.0::DOUBLE WHEN i % 2 = 0 THEN 1.0::DOUBLE / (i + 1) ELSE 0.5::DOUBLE END AS a FROM o
), n AS (SELECT *, CASE WHEN max(a) OVER w - min(a) OVER w < 1e-12 THEN 0.0::DOUBLE ELSE (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) END AS api FROM g WINDOW w AS (PARTITION BY query_id)
), y AS (SELECT *, round(0.65::DOUBLE * score + 0.35::DOUBLE * api, 12) AS blended FROM n
), z AS (SELECT *, row_number() OVER (PARTITION BY query_id, sig ORDER BY blended DESC, cand_pos) AS nth FROM y WHERE blended >= 0.2 AND sig <> '')
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, cand_pos) AS INT) AS rank, chunk_id, blended AS score, round(api, 6) AS api FROM z WHERE nth = 1 QUALIFY rank <= 5"""
)
def rerank_blend(spark, d):
    rows = retrieval.hybrid(retrieval.usable(retrieval.dense_candidates(indexed(spark, d), asked(spark, d))))
    answers = asked(spark, d).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(3))).alias("index"))
    answers = answers.select("*", F.expr("CASE WHEN index % 2 = 0 THEN 1.0D / (index + 1) END").alias("relevance_score"), F.lit(0.5).alias("score"))
    return retrieval.ranked(retrieval.rerank_blend(rows, answers)).select("query_id", "rank", "chunk_id", "score", F.round("api_rerank_score", 6).alias("api"))


_STUDY = _CHUNKS + """, b AS (SELECT doc_id, chunk_index, '[Source: ' || source || ' | chunk=' || chunk_index || ']' || chr(10) AS header, text FROM chunks
), o AS (SELECT *, sum(len(header) + len(text) + 2) OVER (PARTITION BY doc_id ORDER BY chunk_index) - 2 AS used FROM b
), k AS (SELECT doc_id, chunk_index, header || CASE WHEN used > {most} THEN substr(text, 1, {most} - 3 - len(header)) || '...' ELSE text END AS text FROM o WHERE chunk_index = 0 OR used <= {most})
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS context FROM k GROUP BY doc_id"""


def study_chunks(spark, d) -> DataFrame:
    return chunks(spark, d).select(F.col("source_path").cast("long").alias("doc_id"), F.col("chunk_index").alias("pos"), "source_name", "chunk_index", "text")


@query(_STUDY.replace("{most}", "3000"))
def study_context_pack(spark, d):
    return retrieval.study_context(study_chunks(spark, d), 3000)


@query(_STUDY.replace("{most}", "18000"))
def study_context_pack_whole(spark, d):
    """With the reference's budget of 18,000 characters."""
    return retrieval.study_context(study_chunks(spark, d))


@query("SELECT doc_id AS chunk_id, source AS source_name, 'new' AS version FROM documents WHERE source IN ('src1', 'src2') UNION ALL SELECT doc_id, source, 'old' FROM documents WHERE source NOT IN ('src1', 'src2')")
def replace_by_source(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_name"), F.lit(0).alias("chunk_index"))
    new = docs.filter(F.col("source_name").isin("src1", "src2")).withColumn("version", F.lit("new"))
    return index.replace_by_source(docs.withColumn("version", F.lit("old")), new).drop("chunk_index")


@query(
    """
WITH d AS (SELECT doc_id, source, text FROM documents), new AS (
  SELECT doc_id, source || ' (2)' AS source_name, 'again ' || doc_id AS text FROM d WHERE source = 'src3'
  UNION ALL SELECT doc_id + 100000000, source, 'new ' || doc_id FROM d WHERE source = 'src1'
)
SELECT doc_id AS chunk_id, source_name, text FROM new
UNION ALL SELECT doc_id, source, text FROM d WHERE coalesce(source <> 'src1', true) AND doc_id NOT IN (SELECT doc_id FROM new)"""
)
def reingest(spark, d):
    """All documents in an index, then those of one source anew and those of another under another source: what the index holds."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_name"), F.lit(0).alias("chunk_index"), "text")
    moved = docs.filter("source_name = 'src3'").select("chunk_id", F.concat("source_name", F.lit(" (2)")).alias("source_name"), "chunk_index", F.concat(F.lit("again "), "chunk_id").alias("text"))
    new = docs.filter("source_name = 'src1'").select((F.col("chunk_id") + 100_000_000).alias("chunk_id"), "source_name", "chunk_index", F.concat(F.lit("new "), "chunk_id").alias("text"))
    folder = shared_path(spark, "reingest")
    index.ingest(folder, "docs", docs)
    index.ingest(folder, "docs", moved.unionByName(new))
    return index.open_collection(spark, folder, "docs").select("chunk_id", "source_name", "text")


def _stem_sql(x: str) -> str:
    ru, en = "|".join(sorted(text.RU_SUFFIXES, key=len, reverse=True)), "|".join(text.EN_SUFFIXES)
    return rf"CASE WHEN len({x}) >= 6 THEN regexp_replace(regexp_replace(replace({x}, 'ё', 'е'), '^(.{{4,}}?)(?:{ru})$', '\1'), '^(.{{4,}}?)(?:{en})$', '\1') ELSE replace({x}, 'ё', 'е') END"


_STOP = ", ".join(f"'{w}'" for w in sorted({*text.STOPWORDS, *text.GENERIC_WORDS}))
_CONCEPTS = rf"""
WITH s AS (SELECT doc_id, generate_subscripts(ss, 1) AS sid, unnest(ss) AS sentence FROM (SELECT doc_id, {_LINE_SENT} AS ss FROM documents)
), w AS (SELECT doc_id, sid, unnest(regexp_extract_all(lower(sentence), '[a-zа-яё0-9]+')) AS w FROM s
), t AS (SELECT doc_id, sid, {_stem_sql('w')} AS term FROM w WHERE len(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+')
), tt AS (SELECT * FROM t WHERE len(term) >= 3 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({_STOP})
), n AS (SELECT doc_id, count(*) AS n_sentences FROM s GROUP BY doc_id
), st AS (SELECT doc_id, term, count(*) AS freq, count(DISTINCT sid) AS sentence_df FROM tt GROUP BY doc_id, term
), pool AS (
  SELECT *, sentence_df / n_sentences AS ratio FROM st JOIN n USING (doc_id) WHERE freq >= 2 AND sentence_df / n_sentences <= 0.65
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, ratio DESC, term) <= 40
), p AS (SELECT DISTINCT doc_id, sid, term FROM tt SEMI JOIN pool USING (doc_id, term)
), co AS (SELECT a.doc_id, a.term AS src, b.term AS dst, count(*) AS weight FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.sid = b.sid AND a.term < b.term GROUP BY ALL
), dg AS (SELECT doc_id, term, CAST(sum(weight) AS BIGINT) AS degree FROM (SELECT doc_id, src AS term, weight FROM co UNION ALL SELECT doc_id, dst, weight FROM co) GROUP BY ALL
), x AS (SELECT pool.*, coalesce(degree, 0) AS degree FROM pool LEFT JOIN dg USING (doc_id, term)
), y AS (
  SELECT *, round(whole_relevance, 9) AS relevance FROM (SELECT *, 0.62 * CASE WHEN max(freq) OVER d - min(freq) OVER d < 1e-12 THEN 1.0 ELSE (freq - min(freq) OVER d) / (max(freq) OVER d - min(freq) OVER d) END
    + 0.38 * CASE WHEN max(degree) OVER d - min(degree) OVER d < 1e-12 THEN 1.0 ELSE (degree - min(degree) OVER d) / (max(degree) OVER d - min(degree) OVER d) END AS whole_relevance FROM x WINDOW d AS (PARTITION BY doc_id))
), best AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, freq DESC, sentence_df, term) AS INT) AS place FROM y QUALIFY place <= 10
), among AS (
  SELECT co.* FROM co JOIN best a ON co.doc_id = a.doc_id AND co.src = a.term JOIN best b ON co.doc_id = b.doc_id AND co.dst = b.term
), edges AS (
  SELECT doc_id, src, dst, weight, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, src, dst) AS INT) AS place FROM among WHERE weight >= 2
), ends AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, src AS term FROM edges UNION ALL SELECT doc_id, dst FROM edges)
), nodes AS (
  SELECT best.* FROM best LEFT JOIN ends USING (doc_id, term) WHERE ends.term IS NOT NULL OR best.doc_id NOT IN (SELECT doc_id FROM edges)
)"""


@query(_CONCEPTS + " SELECT doc_id, term, freq, sentence_df, n_sentences FROM st JOIN n USING (doc_id)")
def concept_term_stats(spark, d):
    return concepts.term_stats(concepts.documents(table(spark, d, "documents")))


@query(_CONCEPTS + " SELECT doc_id, src, dst, weight FROM co")
def cooccurrence_edges(spark, d):
    return concepts.cooccurrence(concepts.documents(table(spark, d, "documents")))


@query(_CONCEPTS + " SELECT doc_id, place, term, freq, sentence_df, degree, relevance FROM nodes")
def graph_nodes(spark, d):
    return concepts.graph(table(spark, d, "documents")).nodes.select("doc_id", "place", "term", "freq", "sentence_df", "degree", "relevance")


@query(_CONCEPTS + " SELECT doc_id, src, dst, weight, place FROM edges")
def graph_edges(spark, d):
    return concepts.graph(table(spark, d, "documents")).edges


_SUMMARY = """, a AS (
  SELECT doc_id, term, freq, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM nodes
), six AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, place) AS j FROM a WHERE i <= 6
), named AS (SELECT doc_id, string_agg(term, ', ' ORDER BY i) AS top_terms, string_agg(term, ', ' ORDER BY i) FILTER (i <= 5) AS key_terms, max(term) FILTER (j = 1) AS dominant FROM six GROUP BY doc_id
), e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, src, dst) AS i FROM among
), l AS (SELECT doc_id, string_agg(src || ' <-> ' || dst || ' (' || weight || ')', '; ' ORDER BY i) AS links FROM e WHERE i <= 3 GROUP BY doc_id
), sums AS (SELECT doc_id, top_terms, dominant, coalesce(links, '') AS links,
  CASE WHEN links IS NULL THEN 'Граф отражает ключевые понятия текста: ' || key_terms || '. Связи между терминами выражены слабо.'
    ELSE 'Граф показывает основные темы текста и их совместные упоминания. Доминирующий фокус: «' || dominant || '». Ключевые термины: ' || key_terms || '. Самые сильные связи: ' || links || '.' END AS summary
  FROM named LEFT JOIN l USING (doc_id))"""


@query(
    _CONCEPTS + _SUMMARY + """ SELECT d.doc_id, coalesce(top_terms, '') AS top_terms, coalesce(dominant, '') AS dominant, coalesce(links, '') AS links,
  coalesce(summary, CASE WHEN d.doc_id IN (SELECT doc_id FROM tt) THEN 'Ключевые понятия в тексте не определены.' ELSE '' END) AS summary
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN sums USING (doc_id)"""
)
def graph_summary(spark, d):
    return concepts.summary(concepts.graph(table(spark, d, "documents")))


_CONTEXTS = """, h AS (SELECT DISTINCT doc_id, sid, term FROM tt SEMI JOIN nodes USING (doc_id, term)
), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY sid) AS i FROM h
), cx AS (SELECT doc_id, term, string_agg(sentence, ' ' ORDER BY sid) AS context FROM k JOIN s USING (doc_id, sid) WHERE i <= 5 GROUP BY doc_id, term)"""


@query(_CONCEPTS + _CONTEXTS + " SELECT doc_id, term, context FROM cx")
def concept_contexts(spark, d):
    return concepts.contexts(concepts.graph(table(spark, d, "documents")))


@query(
    _CONCEPTS + _CONTEXTS + rf""", sh AS (SELECT doc_id, place, term, freq, whole_relevance, {SQUEEZE.format("coalesce(context, 'Ключевой термин: ' || term)")} AS c FROM nodes LEFT JOIN cx USING (doc_id, term))
SELECT doc_id, place, term AS id, term AS label, term || ': ' || freq AS title, greatest(1, freq) AS value, CAST(format('{{:.4f}}', whole_relevance) AS DOUBLE) AS relevance,
  CASE WHEN len(c) <= 180 THEN c ELSE rtrim(substr(c, 1, 177)) || '...' END AS summary FROM sh"""
)
def graph_descriptions(spark, d):
    return concepts.described(concepts.graph(table(spark, d, "documents")))


@query(_CONCEPTS + """ SELECT doc_id, place, src AS "from", dst AS "to", weight AS value, 'Совместные упоминания: ' || weight AS title FROM edges""")
def graph_edge_titles(spark, d):
    return concepts.titled(concepts.graph(table(spark, d, "documents")))


def results(spark, d) -> DataFrame:
    return retrieval.retrieve(indexed(spark, d), asked(spark, d), top_k=40)


@query(_TOP40 + " SELECT query_id, rank, round(score * 100, 2) AS value FROM f WHERE rank <= 8")
def score_line(spark, d):
    return facts.score_line(results(spark, d))


@query(_TOP40 + r" SELECT query_id, count(*) AS chunks, count(DISTINCT source_name) AS sources, round(avg(score) * 100, 2) AS mean_score_percent, CAST(sum(len(regexp_extract_all(text, '\d+(?:[.,]\d+)?%?'))) AS BIGINT) AS numbers FROM f GROUP BY query_id")
def infographic_metrics(spark, d):
    return facts.metrics(results(spark, d))


@query(
    _TOP40 + """, g AS (SELECT query_id, source_name, count(*) AS c, min(rank) AS r FROM f GROUP BY query_id, source_name
), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, r) AS INT) AS place FROM g QUALIFY place <= 4)
SELECT query_id, place, source_name AS name, round(c / sum(c) OVER (PARTITION BY query_id) * 100, 2) AS value FROM k"""
)
def source_pie(spark, d):
    return facts.source_shares(results(spark, d))


#: Tokens of facts: words of three characters and more, no stop words, none of mixed scripts or odd letters, short ones with a vowel.
_FACT_WORDS = r"""list_filter(regexp_extract_all(lower({}), '[a-zа-яё0-9]+'), lambda w: len(w) >= 3
  AND w NOT IN ('это','как','что','или','для','при','без','под','над','после','перед','про','из','до','мы','вы','они','она','оно','его','ее','их','наш','ваш','который','которая','которые','также','чтобы','если','быть','есть','был','была','the','and','for','with','that','this','from','are','was','were','you','your')
  AND NOT (regexp_matches(w, '[a-z]') AND regexp_matches(w, '[а-яё]')) AND NOT regexp_matches(w, '[ьъэ]{{2,}}') AND NOT regexp_matches(w, '[a-z]{{1,2}}[ьъэ]|[ьъэ][a-z]{{1,2}}')
  AND (len(w) > 4 OR regexp_matches(w, '[aeiouyаеёиоуыэюя]')))"""
_THEMES = _TOP40 + rf""", ft AS (SELECT query_id, rank, greatest(0.1, score) AS s, {_FACT_WORDS.format(_CLEAN.format('text'))} AS t FROM f
), fp AS (SELECT query_id, rank, s, t, list_filter(list_transform(range(1, len(t)), lambda i: CASE WHEN len(t[i]) >= 4 AND len(t[i + 1]) >= 4 THEN t[i] || ' ' || t[i + 1] END), lambda p: p IS NOT NULL) AS two FROM ft
), pp AS (SELECT query_id, rank, s, CASE WHEN len(two) < 4 THEN list_concat(two, t[1:8]) ELSE two END AS ps FROM fp
), ph AS (SELECT query_id, rank, s, generate_subscripts(ps, 1) AS pos, unnest(ps) AS phrase FROM pp
), sm AS (SELECT query_id, phrase, round(sum(s), 9) AS w, min({{{{'rank': rank, 'pos': pos}}}}) AS seen FROM ph GROUP BY ALL
), th AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY w DESC, seen) AS INT) AS place FROM sm QUALIFY place <= {{most}}
), bars AS (SELECT query_id, place, phrase AS name, round(w / sum(w) OVER (PARTITION BY query_id) * 100, 2) AS value FROM th)""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")


@query(_THEMES.replace("{most}", "8") + " SELECT query_id, place, name, value FROM bars")
def theme_weights_bar(spark, d):
    return facts.theme_shares(results(spark, d))


_SAID = _TOP40 + rf""", cl AS (SELECT query_id, rank, {_CLEAN.format('text')} AS clean FROM f
), wd AS (SELECT query_id, rank, {_FACT_WORDS.format(_CLEAN.format('clean'))} AS ws FROM cl
), we AS (SELECT query_id, rank, generate_subscripts(ws, 1) AS pos, unnest(ws) AS term FROM wd
), wc AS (SELECT query_id, term, count(*) AS n, min(CAST(rank AS BIGINT) * 1000000000 + pos) AS seen FROM we GROUP BY ALL
), tp AS (SELECT query_id, list(term) AS top FROM (SELECT * FROM wc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, seen) <= 25) GROUP BY query_id
), sp AS (SELECT query_id, rank, string_split(regexp_replace(regexp_replace(clean, '\n+', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM cl
), se AS (SELECT query_id, rank, generate_subscripts(ss, 1) AS pos, {SQUEEZE.format('unnest(ss)')} AS c FROM sp
), sc2 AS (SELECT query_id, rank, pos, CASE WHEN len(c) <= 170 THEN c WHEN rtrim(regexp_extract(substr(c, 1, 170), '^(.*) [^ ]*$', 1)) = '' THEN substr(c, 1, 170) ELSE rtrim(regexp_extract(substr(c, 1, 170), '^(.*) [^ ]*$', 1)) END AS sentence FROM se
), sf AS (SELECT *, {_FACT_WORDS.format(_CLEAN.format('sentence'))} AS ws FROM sc2 WHERE len(sentence) >= 45 AND NOT regexp_matches(sentence, '\.{{4,}}\s*\d+$')
), sv AS (SELECT query_id, rank, pos, sentence, trim(lower(sentence), ' .') AS norm,
    round(1.2 * len(list_filter(ws, lambda t: list_contains(top, t))) + 1.1 * len(regexp_extract_all(sentence, '\d+(?:[.,]\d+)?%?')) + 0.1 * len(list_distinct(ws)), 6) AS score FROM sf JOIN tp USING (query_id) WHERE len(ws) >= 4
), s1 AS (SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY query_id, norm ORDER BY rank, pos) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS INT) AS place, sentence, CAST(score AS DOUBLE) AS score FROM s1 QUALIFY place <= 5"""


@query(_SAID)
def content_insights(spark, d):
    return facts.insights(results(spark, d), require_cyrillic=False)


@query(_TOP40 + " SELECT query_id, source_name AS source, round(sum(score), 9) AS score, count(*) AS chunks FROM f GROUP BY query_id, source_name")
def source_scores(spark, d):
    return facts.source_scores(results(spark, d))


_POINTS = """, given AS ({rows}), ids AS (SELECT query_id, max(place) AS n FROM given GROUP BY query_id
), filled AS (SELECT query_id, place, name, CAST(value AS DOUBLE) AS value FROM given UNION ALL SELECT query_id, place, '{label} ' || place, 0.0 FROM (SELECT query_id, CAST(unnest(range(n + 1, {least} + 1)) AS INT) AS place FROM ids))
SELECT query_id, place, '{prefix}-' || place AS id, name, value FROM filled"""


def _points(rows: DataFrame) -> DataFrame:
    rows = rows.select("query_id", F.posexplode("data").alias("place", "p"))
    return rows.select("query_id", (F.col("place") + 1).alias("place"), "p.id", "p.name", "p.value")


def _points_sql(cte: str, rows: str, prefix: str, least: int, label: str) -> str:
    return cte + _POINTS.replace("{rows}", rows).replace("{prefix}", prefix).replace("{least}", str(least)).replace("{label}", label)


_BAR_ROWS = "SELECT query_id, place, CASE WHEN len(name) <= 48 THEN name WHEN contains(substr(name, 1, 48), ' ') THEN regexp_extract(substr(name, 1, 48), '^(.*) [^ ]*$', 1) ELSE substr(name, 1, 48) END AS name, value FROM bars"
_PIE_ROWS = "SELECT query_id, place, source_name AS name, round(c / sum(c) OVER (PARTITION BY query_id) * 100, 2) AS value FROM k"
_LINE_ROWS = "SELECT query_id, rank AS place, 'Чанк ' || rank AS name, round(score * 100, 2) AS value FROM f WHERE rank <= 6"
_PIE = """, g AS (SELECT query_id, source_name, count(*) AS c, min(rank) AS r FROM f GROUP BY query_id, source_name
), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, r) AS INT) AS place FROM g QUALIFY place <= 4)"""


@query(_points_sql(_THEMES.replace("{most}", "6"), _BAR_ROWS, "bar", 4, "Тема"))
def infographic_bar(spark, d):
    return _points(facts.bar_points(results(spark, d)))


@query(_points_sql(_TOP40 + _PIE, _PIE_ROWS, "pie", 3, "Источник"))
def infographic_pie(spark, d):
    return _points(facts.pie_points(results(spark, d)))


@query(_points_sql(_TOP40, _LINE_ROWS, "line", 4, "Чанк"))
def infographic_line(spark, d):
    return _points(facts.line_points(results(spark, d)))


def _data_sql(name: str, rows: str, least: int, label: str) -> str:
    """A chart's points of every query with a result, filled up with zeros, as a list."""
    return f""", given_{name} AS ({rows}), ids_{name} AS (SELECT query_id, coalesce(max(place), 0) AS n FROM (SELECT DISTINCT query_id FROM f) LEFT JOIN given_{name} USING (query_id) GROUP BY query_id
), full_{name} AS (SELECT query_id, place, name, CAST(value AS DOUBLE) AS value FROM given_{name} UNION ALL SELECT query_id, place, '{label} ' || place, 0.0 FROM (SELECT query_id, CAST(unnest(range(n + 1, {least} + 1)) AS INT) AS place FROM ids_{name})
), data_{name} AS (SELECT query_id, list({{'id': '{name}-' || place, 'name': name, 'value': value}} ORDER BY place) AS {name}_data FROM full_{name} GROUP BY query_id)"""


_INSIGHT_PARTS, _INSIGHTS = _SAID.removeprefix(_TOP40).rsplit("\nSELECT ", 1)
_FACT_SHEETS = (
    _THEMES.replace("{most}", "6") + _PIE + _data_sql("bar", _BAR_ROWS, 4, "Тема") + _data_sql("pie", _PIE_ROWS, 3, "Источник") + _data_sql("line", _LINE_ROWS, 4, "Чанк") + _INSIGHT_PARTS + ", five AS (SELECT " + _INSIGHTS + r"""
), mt AS (SELECT query_id, count(*) AS chunks, count(DISTINCT source_name) AS sources, round(avg(score) * 100, 2) AS mean_score, CAST(sum(len(regexp_extract_all(text, '\d+(?:[.,]\d+)?%?'))) AS BIGINT) AS numbers FROM f GROUP BY query_id
), fo AS (SELECT query_id, list(sentence ORDER BY place) AS found FROM five GROUP BY query_id
), al AS (SELECT *, coalesce(found, []) AS held, [
    format('Ключевая тема контекста: {} ({:.1f}% тематического веса).', bar_data[1].name, bar_data[1].value),
    'В документе доминируют темы: ' || array_to_string(list_transform(bar_data[1:3], lambda p: p.name), ', ') || '.',
    format('Средний релевантный score составляет {:.1f}%, анализ охватывает {} чанков.', mean_score, chunks)] AS more
  FROM mt JOIN data_bar USING (query_id) JOIN data_pie USING (query_id) JOIN data_line USING (query_id) LEFT JOIN fo USING (query_id)
)
SELECT query_id, CAST(to_json({'title': 'Инфографика', 'subtitle': 'Агрегированный контекст источников', 'metrics': [
    {'id': 'metric-1', 'name': 'Показатель 1', 'value': CAST(chunks AS VARCHAR), 'unit': 'шт', 'description': 'Количество отобранных фрагментов контекста.'},
    {'id': 'metric-2', 'name': 'Показатель 2', 'value': CAST(sources AS VARCHAR), 'unit': 'шт', 'description': 'Число источников в выборке.'},
    {'id': 'metric-3', 'name': 'Показатель 3', 'value': CAST(mean_score AS VARCHAR), 'unit': '%', 'description': 'Средний интегральный score по retrieval.'},
    {'id': 'metric-4', 'name': 'Показатель 4', 'value': CAST(numbers AS VARCHAR), 'unit': 'шт', 'description': 'Количество обнаруженных числовых упоминаний.'}],
  'bar_chart': {'title': 'График 1', 'x_axis_label': 'Категория', 'y_axis_label': 'Значение', 'legend': 'Распределение по категориям', 'data': bar_data},
  'pie_chart': {'title': 'График 2', 'legend': 'Доли категорий', 'data': pie_data},
  'line_chart': {'title': 'График 3', 'x_axis_label': 'Шаг', 'y_axis_label': 'Значение', 'legend': 'Динамика показателя', 'data': line_data},
  'key_insights': CASE WHEN len(held) < 3 THEN list_concat(held, more)[1:5] ELSE held END}) AS VARCHAR) AS facts FROM al"""
)


@query(_FACT_SHEETS)
def infographic_facts(spark, d):
    """The whole fact sheet as JSON."""
    return facts.payload(results(spark, d), require_cyrillic=False).select("query_id", F.to_json("facts").alias("facts"))


@query(_TOP5 + r""" SELECT query_id, string_agg('[source#' || rank || ']' || chr(10) || 'source_name=' || source_name || chr(10) || 'chunk_index=0' || chr(10) || 'text=' || regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank) AS context FROM f GROUP BY query_id""")
def presentation_context(spark, d):
    return retrieval.numbered_context(retrieval.retrieve(indexed(spark, d), asked(spark, d)))


@query(_TOP5 + r""" SELECT query_id, rank AS place, source_name AS title, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 260) AS bullet, CAST(count(*) OVER (PARTITION BY query_id) + 1 AS INT) AS slides_count FROM f""")
def presentation_slides(spark, d):
    """Without a model, a slide for each result."""
    found = retrieval.retrieve(indexed(spark, d), asked(spark, d))
    rows = generate.presentation(found, asked(spark, d)).select("query_id", F.posexplode("plan.slides").alias("place", "s"), "slides_count")
    return rows.select("query_id", (F.col("place") + 1).alias("place"), "s.title", F.col("s.bullets")[0].alias("bullet"), "slides_count")


@query("SELECT source || ' (renamed)' AS source_name, count(*) AS n_docs FROM documents WHERE doc_id % 2 = 0 AND len(trim(text)) > 0 GROUP BY source UNION ALL SELECT source, count(*) FROM documents WHERE doc_id % 2 = 1 AND len(trim(text)) > 0 GROUP BY source")
def source_overrides(spark, d):
    docs = table(spark, d, "documents")
    names = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("path"), F.concat("source", F.lit(" (renamed)")).alias("name"))
    return chunking.build_chunks(docs, "doc_id", "source", overrides=names).groupBy("source_name").agg(F.countDistinct("source_path").alias("n_docs"))


@query("""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, CASE WHEN count(*) >= 6 THEN string_agg(CASE WHEN role = 'user' THEN 'Ведущий 1: ' ELSE 'Ведущий 2: ' END || text, chr(10) ORDER BY turn) ELSE '' END AS dialogue
FROM (SELECT conv_id, turn, role, replace(text, chr(10), ' ') AS text FROM t) GROUP BY conv_id""")
def conversation_dialogues(spark, d):
    """Conversations as a model would answer them, "Speaker n:" a line, made dialogues of two hosts."""
    rows = table(spark, d, "conversations").filter(F.col("role").isin("user", "assistant"))
    line = F.concat(F.when(F.col("role") == "user", "Speaker 1: ").otherwise("Ведущий 2: "), F.replace(text.strip(F.col("text")), F.lit("\n"), F.lit(" ")))
    raw = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("raw"))
    return raw.select("conv_id", dialogue.normalized(F.col("raw")).alias("dialogue"))


@query("SELECT doc_id, len(cards) AS cards, len(cards) AS tests FROM (SELECT doc_id, list_slice(list_filter({s}, lambda x: len(x) >= 40), 1, 10) AS cards FROM documents)".replace("{s}", _LINE_SENT.replace("text", "substr(text, 1, 18000)")))
def flash_packs(spark, d):
    packs = generate.flash_materials(table(spark, d, "documents").select("doc_id", "text"), 10, 10)
    good = F.filter("pack.tests", lambda t: (F.size(t["options"]) >= 2) & (t["options"][t["correct_index"]] != ""))
    single = F.filter(F.transform("pack.flashcards", lambda c: c["answer"]), lambda a: a != "")
    return packs.select("doc_id", F.size("pack.flashcards").cast("long").alias("cards"), F.when(F.size(F.array_distinct(F.slice(single, 1, 4))) > 1, F.size(good)).otherwise(F.size("pack.flashcards")).cast("long").alias("tests"))


@query(r"SELECT page_id, coalesce(nullif(trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '""'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), ''), 'untitled') AS title FROM pages".replace('\'""\'', "'\"'"))
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", readers.html_title(F.col("html")).alias("title"))


@query()
def html_preclean(spark, d):
    return table(spark, d, "pages").select("page_id", readers.preclean_html(F.col("html")).alias("text"))


@query(r"SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", text.normalize_url(F.col("url")).alias("url"))


@query(
    _DIALOGUE + rf"""
SELECT doc_id, CAST(n - 1 AS INT) AS line_no, CAST((n - 1) % 2 + 1 AS INT) AS speaker, part AS text, substr({SQUEEZE.format(_SPOKEN)}, 1, 280) AS spoken
FROM (SELECT doc_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS part FROM p WHERE n_sentences >= 6 AND len(parts) >= 6)"""
)
def dialogue_segments(spark, d):
    docs = table(spark, d, "documents").withColumn("dialogue", dialogue.coerced(F.col("text")))
    return dialogue.segments(docs, "doc_id", F.col("dialogue"))


@query("SELECT event_id, CAST(value AS DOUBLE) / 100 AS number FROM events")
def to_float(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), F.lit("%")).alias("raw"))
    return rows.select("event_id", text.to_float(F.col("raw")).alias("number"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_llm_json(spark, d):
    raw = F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", structured.parsed(raw, "k bigint")["k"].alias("k"))


@query("""
WITH r AS (SELECT doc_id, len(text) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 2000 THEN 'bar-1' ELSE 'bar-9' END AS id, CASE WHEN n > 2000 THEN 'length' ELSE 'none' END AS name, CASE WHEN n > 2000 THEN CAST(n AS DOUBLE) ELSE 0.0 END AS value FROM r""")
def normalize_points(spark, d):
    raw = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit("length").alias("name"), F.when(F.length("text") > 2000, F.length("text").cast("string")).otherwise("-5").alias("value")), F.struct(F.lit(None).cast("string").alias("id"), F.lit("").alias("name"), F.lit("1").alias("value")))
    none = F.array(F.struct(F.lit("bar-9").alias("id"), F.lit("none").alias("name"), F.lit(0.0).alias("value")))
    rows = table(spark, d, "documents").select("doc_id", F.explode(structured.normalized_points(raw, "bar", 1, 8, none)).alias("p"))
    return rows.select("doc_id", "p.id", "p.name", "p.value")


@query(
    r"""
WITH w AS (SELECT doc_id, list_concat(regexp_split_to_array(text, '\s+')[1:4], ['', '', '']) AS four, list_concat(regexp_split_to_array(text, '\s+')[1:2], ['', '', '']) AS two FROM documents)
SELECT doc_id, CAST(to_json({'title': 'Extracted Table', 'columns': ['a', 'column_2', 'c'], 'rows': [four[1:3], two[1:3]]}) AS VARCHAR) AS "table" FROM w"""
)
def normalize_table(spark, d):
    words = F.slice(F.split("text", r"\s+"), 1, 4)
    return table(spark, d, "documents").select("doc_id", F.to_json(structured.normalized_table(F.array(F.lit("a"), F.lit(" "), F.lit("c")), F.array(words, F.slice(words, 1, 2)))).alias("table"))


@query(
    rf"""
WITH s AS (SELECT doc_id, {_LINE_SENT.replace('text', 'substr(text, 1, 18000)')} AS ss FROM documents
), c AS (SELECT doc_id, list_slice(list_filter(ss, lambda x: len(x) >= 40), 1, 10) AS cs FROM s
), r AS (SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INT) AS pos, unnest(cs) AS sentence FROM c
), w AS (SELECT *, list_max(list_transform(regexp_split_to_array(sentence, '\s+'), lambda w: {{'n': len(w), 'w': w}})).w AS answer FROM r)
SELECT doc_id, pos, replace(sentence, answer, '____') AS question, answer FROM w"""
)
def flashcards_offline(spark, d):
    return generate.flashcards(table(spark, d, "documents"))


@query(
    rf"""
WITH s AS (SELECT doc_id, {_LINE_SENT.replace('text', 'substr(text, 1, 18000)')} AS ss FROM documents
), c AS (SELECT doc_id, list_slice(list_filter(ss, lambda x: len(x) >= 40), 1, 10) AS cs FROM s
), r AS (SELECT doc_id, generate_subscripts(cs, 1) AS pos, unnest(cs) AS sentence FROM c
), w AS (SELECT *, list_max(list_transform(regexp_split_to_array(sentence, '\s+'), lambda w: {{'n': len(w), 'w': w}})).w AS answer FROM r
), q AS (SELECT doc_id, pos, replace(sentence, answer, '____') AS question, answer FROM w
), o AS (SELECT doc_id, list(answer ORDER BY pos) FILTER (pos <= 4) AS a FROM q GROUP BY doc_id
), d AS (SELECT doc_id, list_slice(list_filter(a, lambda x, i: list_position(a, x) = i), 1, 3) AS others FROM o
), t AS (SELECT doc_id, pos, question, answer, list_sort(list_distinct(list_append(others, answer))) AS options FROM q JOIN d USING (doc_id))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS pos, question, options, CAST(list_position(options, answer) - 1 AS INT) AS correct_index
FROM t WHERE len(options) >= 2"""
)
def flash_tests(spark, d):
    """The tests of each document's pack: questions, options and the right one's place."""
    packs = generate.flash_materials(table(spark, d, "documents").select("doc_id", "text"), 10, 10)
    rows = packs.select("doc_id", F.posexplode_outer("pack.tests").alias("pos", "t")).filter(F.col("pos").isNotNull())
    return rows.select("doc_id", "pos", "t.question", "t.options", "t.correct_index")


@query(
    rf"SELECT doc_id, array_to_string(list_slice(string_split(regexp_replace(trim(substr({SQUEEZE.format('text')}, 1, 9000)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1, 3), ' ') AS summary FROM documents"
)
def summarize_offline(spark, d):
    return generate.summarize(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "summary")


@query(
    _TOP5 + rf""", one AS (SELECT f.query_id, {STRIP.format('f.text')} AS text, b.text AS question FROM f JOIN benchmark b ON b.item_id = f.query_id WHERE rank = 1
), qs AS (SELECT query_id, list_distinct(regexp_extract_all(lower(question), '[\pL\p{{Mn}}\p{{Mc}}\p{{Nd}}\p{{Pc}}]+')) AS asked, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM one
), sn AS (SELECT query_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS sentence, asked FROM qs
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(asked, regexp_extract_all(lower(sentence), '[\pL\p{{Mn}}\p{{Mc}}\p{{Nd}}\p{{Pc}}]+'))) DESC, i) AS place FROM sn)
SELECT query_id, string_agg(sentence, ' ' ORDER BY i) AS answer FROM k WHERE place <= 3 GROUP BY query_id"""
)
def ask_offline(spark, d):
    answers = retrieval.context(retrieval.retrieve(indexed(spark, d), asked(spark, d))).join(asked(spark, d).select("query_id", "query_text"), "query_id")
    return generate.ask(answers).select("query_id", "answer")


@query(
    _TOP40 + rf""" SELECT query_id, rank, source_name AS title, [rank] AS source_ids,
  list_transform(list_slice(list_transform({_LINE_SENT}, lambda x: {SQUEEZE.format('x')}), 1, 5), lambda x: CASE WHEN len(x) <= 160 THEN x ELSE rtrim(substr(x, 1, 157)) || '...' END) AS bullets
FROM f WHERE rank <= 8"""
)
def slide_plan_offline(spark, d):
    return generate.slide_plan(results(spark, d))
