"""What a service offers, as functions of DataFrames: parameters are checked here, work is done by the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.text import normalize_pace, normalize_tone
from .operators import chunking, concepts, dialogue, generate, index, retrieval
from .operators.generate import OFFLINE, Backends
from .sources import readers


@dataclass(frozen=True)
class Settings:
    """Where the index is, and defaults. Explicit values, 0 included, go before them. New collections keep postings if keep_postings says so; retrieval uses those that are kept."""

    folder: str
    collection: str = "docs"
    chunk_size: int = chunking.SIZE
    chunk_overlap: int = chunking.OVERLAP
    top_k: int = retrieval.TOP_K
    fetch_k: int = retrieval.FETCH_K
    min_score: float = retrieval.MIN_SCORE
    dense_weight: float = retrieval.DENSE_WEIGHT
    rerank_blend: float = retrieval.RERANK_BLEND
    model: str = "default"
    backends: Backends = OFFLINE
    keep_postings: bool = False


def health() -> dict:
    return {"status": "ok"}


def either(value, default):
    """The value that is given, 0 too, else the default."""
    return default if value is None else value


def zero_to_none(value: int | None) -> int | None:
    return value if value is not None and value > 0 else None


def within(name: str, value: float, low: float, high: float) -> float:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in [{low}, {high}], not {value}")
    return value


def _supported(paths: list[str]) -> None:
    for p in paths:
        if not p.lower().endswith(readers.SUFFIXES):
            raise ValueError(f"unsupported file: {p}")


def _text_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, text of supported files; a file without text is an error where it is read."""
    _supported(paths)
    rows = readers.read_documents(readers.collect_files(spark, paths))
    return rows.withColumn("text", F.when(F.trim("text") == "", F.raise_error(F.concat(F.lit("no text in "), F.col("path"))).cast("string")).otherwise(F.col("text")))


def ingest_documents(s: Settings, docs: DataFrame, path: str = "path", source_name: str = "source_name", collection: str | None = None, chunk_size: int = 0, chunk_overlap: int = 0, overrides: DataFrame | None = None, files: int | None = None) -> dict:
    """Chunk, embed and index texts (path, source_name, text)."""
    size, overlap = (chunk_size if chunk_size > 0 else s.chunk_size), (chunk_overlap if chunk_overlap > 0 else s.chunk_overlap)
    chunks = chunking.build_chunks(docs, path, source_name, "text", size, overlap, overrides)
    return index.ingest(s.folder, collection or s.collection, generate.embed(chunks, "text", backends=s.backends, model=s.model), files=files, keep_postings=s.keep_postings)


def ingest(spark: SparkSession, s: Settings, paths: list[str], collection: str | None = None, chunk_size: int = 0, chunk_overlap: int = 0, overrides: DataFrame | None = None) -> dict:
    """Index files; files that give no chunk at all are an error, with nothing changed."""
    _supported(paths)
    docs = readers.read_documents(readers.collect_files(spark, paths)).withColumn("source_name", F.regexp_extract("path", "([^/]+)$", 1))
    done = ingest_documents(s, docs, collection=collection, chunk_size=chunk_size, chunk_overlap=chunk_overlap, overrides=overrides, files=len(paths))
    if not done["inserted_chunks"]:
        raise ValueError("no text in the files")
    return done


def retrieve(spark: SparkSession, s: Settings, queries: DataFrame, collection: str | None = None, top_k: int | None = None, fetch_k: int | None = None, min_score: float | None = None, dense_weight: float | None = None, source_name: str | None = None, reranked: DataFrame | None = None, rerank: retrieval.Rerank | None = None) -> DataFrame:
    """query_id, query_text, rank and the rest of each query's results, for queries (query_id, query_text); a blank query is an error. A reranker is called once a query."""
    top = int(within("top_k", either(top_k, s.top_k), 1, 50))
    fetch = int(within("fetch_k", either(fetch_k, s.fetch_k), 1, 200))
    least, weight = within("min_score", either(min_score, s.min_score), 0, 1), within("dense_weight", either(dense_weight, s.dense_weight), 0, 1)
    asked = queries.select("query_id", F.when(F.length("query_text") > 0, F.col("query_text")).otherwise(F.raise_error(F.lit("empty query")).cast("string")).alias("query_text"))
    asked = generate.embed(asked, "query_text", "query_vector", s.backends, s.model, is_query=True)
    held = retrieval.with_defaults(index.open_collection(spark, s.folder, collection or s.collection))
    return retrieval.retrieve(held, asked, top, fetch, least, weight, source_name, reranked, rerank, s.rerank_blend, index.postings(spark, s.folder, collection or s.collection))


def ask(spark: SparkSession, s: Settings, queries: DataFrame, backends: Backends | None = None, **how) -> DataFrame:
    """query_id, answer, used_chunks, model; a query without a result has a null answer and no chunk."""
    found = retrieve(spark, s, queries, **how)
    rows = retrieval.context(found).join(queries.select("query_id", "query_text"), "query_id")
    answers = generate.ask(rows, backends=backends) if backends else generate.ask(rows)
    used = found.groupBy("query_id").agg(F.count("*").cast("int").alias("used_chunks"))
    out = queries.select("query_id").join(answers.select("query_id", "answer"), "query_id", "left").join(used, "query_id", "left")
    return out.select("query_id", "answer", F.coalesce("used_chunks", F.lit(0)).alias("used_chunks"), F.lit(s.model).alias("model"))


def mind_maps(docs: DataFrame, top_n: int = concepts.TOP_N, min_freq: int = concepts.MIN_FREQ, min_edge: int = concepts.MIN_EDGE, answers: DataFrame | None = None, backends: Backends | None = None) -> DataFrame:
    """doc_id, graph (JSON) of texts (doc_id, text); terms are described by answers at hand, or by a model that is asked once a document, or from their contexts."""
    for name, value in (("top_n", top_n), ("min_freq", min_freq), ("min_edge", min_edge)):
        within(name, value, 1, 1000)
    g = concepts.graph(docs, top_n, min_freq, min_edge)
    return concepts.payload(g, concepts.asked_descriptions(g, backends) if answers is None and backends else answers)


def file_mind_maps(files: DataFrame, **how) -> DataFrame:
    """file_name, nodes, edges, meta (source, filename, nodes_count, edges_count, summary, top_terms) of uploads (file_name, content), a name once."""
    maps = mind_maps(readers.uploaded_texts(files).withColumnRenamed("file_name", "doc_id").select("doc_id", "text"), **how)
    kind = "nodes array<struct<id:string,label:string,title:string,value:bigint,relevance:double,summary:string>>, edges array<struct<`from`:string,`to`:string,value:bigint,title:string>>, meta struct<summary:string,top_terms:array<string>>"
    rows = maps.select(F.col("doc_id").alias("file_name"), F.from_json("graph", kind).alias("g"))
    meta = F.struct(F.lit("file").alias("source"), F.col("file_name").alias("filename"), F.size("g.nodes").alias("nodes_count"), F.size("g.edges").alias("edges_count"), "g.meta.summary", "g.meta.top_terms")
    return rows.select("file_name", "g.nodes", "g.edges", meta.alias("meta"))


def mind_map_pages(docs: DataFrame, title: str, **how) -> DataFrame:
    """doc_id, html, nodes, edges: each document's graph as a page, made in the tasks."""

    @F.pandas_udf("struct<html:string,nodes:int,edges:int>")
    def page(graph):
        import pandas as pd

        return pd.DataFrame([sinks.graph_page(title, g) for g in graph], columns=["html", "nodes", "edges"])

    return mind_maps(docs, **how).select("doc_id", page("graph").alias("p")).select("doc_id", "p.*")


def summaries(spark: SparkSession, paths: list[str], most_sentences: int = 10, backends: Backends = OFFLINE, **how) -> DataFrame:
    return generate.summarize(_text_of(spark, paths), most_sentences, backends, **how)


def flashcards(spark: SparkSession, paths: list[str], cards: int = 10, tests: int = 5, backends: Backends | None = None, **how) -> DataFrame:
    """path, text, pack."""
    return generate.flash_materials(_text_of(spark, paths), int(within("cards", cards, 1, 100)), int(within("tests", tests, 1, 100)), backends=backends, **how)


def tables(docs: DataFrame, kind: str = "json", hint: str = "", backends: Backends | None = None) -> DataFrame:
    """docs with file and media_type: each text's table as JSON, CSV or XLSX."""
    rows = generate.extract_table(docs, hint, backends) if backends else generate.extract_table(docs, hint)

    @F.pandas_udf("struct<file:binary,media_type:string>")
    def written(table):
        import pandas as pd

        return pd.DataFrame([sinks.table_file(t, kind) for t in table.to_dict("records")], columns=["file", "media_type"])

    return rows.withColumn("written", written("table")).select(*docs.columns, "written.*")


def file_tables(files: DataFrame, kind: str = "json", hint: str = "", backends: Backends | None = None) -> DataFrame:
    """file_name, file, media_type: the table of each upload (file_name, content)."""
    return tables(readers.uploaded_texts(files), kind, hint, backends).select("file_name", "file", "media_type")


#: Voices that a dialogue's hosts can have, and those that they have if nothing is said.
SPEAKERS = ("aidar", "baya", "eugene", "kseniya", "xenia")
HOST_VOICES = ("baya", "xenia")


def speakers() -> list[str]:
    return list(SPEAKERS)


def file_podcasts(files: DataFrame, backends: Backends, speaker_1: str = HOST_VOICES[0], speaker_2: str = HOST_VOICES[1], voices: Callable[[str, str], list[float] | None] | None = None, model: str = "default", **how) -> DataFrame:
    """file_name, dialogue, source, model, has_audio, file, audio, meta (filename, speakers) of uploads (file_name, content); voices take a speaker's name and a text. An unknown speaker is an error."""
    named = (speaker_1, speaker_2)
    for s in named:
        if s not in SPEAKERS:
            raise ValueError(f"unknown speaker: {s}")
    said = None if voices is None else lambda host, text: voices(named[host - 1], text)
    rows = podcasts(readers.uploaded_texts(files), backends, voices=said, key="file_name", **how)
    if voices is None:
        rows = rows.withColumn("file", F.lit(None).cast("string")).withColumn("audio", F.lit(None).cast("binary"))
    meta = F.struct(F.col("file_name").alias("filename"), F.array(*map(F.lit, named)).alias("speakers"))
    return rows.select("file_name", "dialogue", F.lit("file").alias("source"), F.lit(model).alias("model"), F.col("audio").isNotNull().alias("has_audio"), "file", "audio", meta.alias("meta"))


def podcasts(docs: DataFrame, backends: Backends, tone: str = "scientific", pace: str = "normal", topic: str = "Без названия", voices: Callable[[int, str], list[float] | None] | None = None, key: str = "doc_id") -> DataFrame:
    """docs with dialogue, and, where voices are given, file and audio. Tone and pace may be synonyms; unknown ones are an error."""
    row = docs.sparkSession.range(1).select(normalize_tone(F.lit(tone)).alias("tone"), normalize_pace(F.lit(pace)).alias("pace")).first()
    rows = dialogue.generated(docs, dialogue.DialogueConfig(row["tone"], row["pace"]), backends, topic)
    if voices is None:
        return rows
    return rows.join(sinks.audio_files(dialogue.segments(rows, key, F.col("dialogue")), key, voices), key, "left")


def presentations(results: DataFrame, queries: DataFrame, most: int = 8, backends: Backends | None = None, prefix: str = "presentation") -> DataFrame:
    """query_id, plan, slides_count, file_name, file: a deck for each query with a result."""
    rows = generate.presentation(results, queries, most, backends=backends)

    @F.pandas_udf("binary")
    def deck(plan):
        return plan.apply(lambda p: sinks.slides_pptx(p["title"], [(x["title"], list(x["bullets"])) for x in p["slides"]]), axis=1)

    from .functions.text import safe_filename

    return rows.withColumn("file_name", F.concat(safe_filename(F.lit(prefix)), F.lit("-"), F.col("query_id").cast("string"), F.lit(".pptx"))).withColumn("file", deck("plan"))


def presentations_of(spark: SparkSession, s: Settings, queries: DataFrame, most: int = 8, backends: Backends | None = None, prefix: str = "presentation", **how) -> DataFrame:
    """Retrieval and decks in one: query_id, plan, slides_count, file_name, file for queries (query_id, query_text); one without a result has nulls and no slide."""
    from .storage import stored

    found = stored(retrieve(spark, s, queries, **how), "found")
    decks = presentations(found, queries, most, backends, prefix)
    return queries.select("query_id").join(decks, "query_id", "left").withColumn("slides_count", F.coalesce("slides_count", F.lit(0)))


def infographics(results: DataFrame, queries: DataFrame, most: int | None = None, models: dict[str, Backends] | None = None) -> DataFrame:
    """query_id, plan, used_chunks, models_used, failed_models; 0 topics are the default."""
    return generate.infographic(results, queries, zero_to_none(most) or 6, models)


def parse(urls: DataFrame, config: readers.FetchConfig = readers.FetchConfig(), backends: Backends | None = None) -> DataFrame:
    return readers.parsed_pages(readers.fetch_pages(urls, config), backends)


def parse_and_ingest(s: Settings, urls: DataFrame, config: readers.FetchConfig = readers.FetchConfig(), backends: Backends | None = None, **how) -> tuple[DataFrame, dict]:
    """Pages (url, title, indexed, error), and what the ingest of those with a text did."""
    from .storage import stored

    pages = stored(parse(urls, config, backends), "pages")
    done = ingest_documents(s, readers.page_sources(pages), path="url", **how)
    return pages.select("url", "title", (F.trim(F.coalesce("text", F.lit(""))) != "").alias("indexed"), "error"), done
