"""Infographic facts of retrieval results (query_id, rank, source_name, score, text): shares, series, metrics, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structured import padded_points, point_id
from ..functions.text import WS, clean_ocr_noise, clean_token, fact_tokens, has_cyrillic, short_text
from ..storage import stored

NUMBER = r"\d+(?:[.,]\d+)?%?"


def scored(results: DataFrame) -> DataFrame:
    """query_id, rank, text, source, s (the score, 0 at least) and nothing else, so that no column of a caller is in the way."""
    source = F.coalesce(F.when(F.col("source_name") != "", F.col("source_name")), F.concat(F.lit("Источник "), F.col("rank").cast("string")))
    return results.select("query_id", "rank", "text", short_text(source, 64).alias("source"), F.greatest(F.lit(0.0), F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("s"))


def theme_phrases(text: Column) -> Column:
    """Neighbouring clean tokens of four letters and more; under four phrases, the first eight tokens too."""
    t = fact_tokens(text)
    pairs = F.zip_with(t, F.slice(t, F.lit(2), F.greatest(F.lit(0), F.size(t))), lambda a, b: F.when((F.length(a) >= 4) & (F.length(b) >= 4) & clean_token(a) & clean_token(b), F.concat(a, F.lit(" "), b)))
    pairs = F.filter(pairs, lambda p: p.isNotNull())
    return F.when(F.size(pairs) < 4, F.concat(pairs, F.slice(t, 1, 8))).otherwise(pairs)


def top_shares(rows: DataFrame, name: str, weight: Column, most: int) -> DataFrame:
    """query_id, place, name, value: the `most` names of the greatest weight (the first seen, if equal) and their share of these in percent.

    rows have rank and pos, which say what was seen first.
    """
    sums = rows.groupBy("query_id", name).agg(F.round(F.sum(weight), 9).alias("w"), F.min(F.struct("rank", "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "first"))
    top = sums.withColumn("place", place).filter(F.col("place") <= most)
    return top.select("query_id", "place", F.col(name).alias("name"), F.round(F.col("w") / F.sum("w").over(Window.partitionBy("query_id")) * 100, 2).alias("value"))


def theme_shares(results: DataFrame, most: int = 8) -> DataFrame:
    rows = scored(results).select("query_id", "rank", "s", F.posexplode(theme_phrases(F.col("text"))).alias("pos", "phrase"))
    return top_shares(rows, "phrase", F.greatest(F.lit(0.1), F.col("s")), most)


def source_shares(results: DataFrame, most: int = 4) -> DataFrame:
    return top_shares(scored(results).withColumn("pos", F.lit(0)), "source", F.lit(1), most)


def score_line(results: DataFrame, most: int = 8) -> DataFrame:
    return scored(results).filter(F.col("rank") <= most).select("query_id", "rank", F.round(F.col("s") * 100, 2).alias("value"))


def metrics(results: DataFrame) -> DataFrame:
    """query_id, chunks, sources, mean_score_percent, numbers."""
    return scored(results).groupBy("query_id").agg(
        F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"), F.round(F.avg("s") * 100, 2).alias("mean_score_percent"), F.sum(F.regexp_count("text", F.lit(NUMBER))).cast("long").alias("numbers")
    )


def insights(results: DataFrame, limit: int = 5, require_cyrillic: bool = True) -> DataFrame:
    """query_id, place, sentence, score: sentences with many topic words and numbers; the first of equal ones, the best by score."""
    rows = stored(results.select("query_id", "rank", clean_ocr_noise(F.col("text")).alias("clean")), "clean")
    words = rows.select("query_id", "rank", F.posexplode(fact_tokens(F.col("clean"))).alias("pos", "term"))
    counts = words.groupBy("query_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("rank", "pos")).alias("first"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "first"))).filter("place <= 25")
    top = top.groupBy("query_id").agg(F.collect_list("term").alias("top"))
    sents = rows.select("query_id", "rank", F.posexplode(F.split("clean", f"(?<=[.!?]){WS}+|\n+")).alias("pos", "raw")).withColumn("sentence", short_text(F.col("raw"), 170))
    sents = sents.filter((F.length("sentence") >= 45) & ~F.col("sentence").rlike(r"\.{4,}\s*\d+$"))
    if require_cyrillic:
        sents = sents.filter(has_cyrillic(F.col("sentence")))
    sents = sents.withColumn("tokens", fact_tokens(F.col("sentence"))).filter(F.size("tokens") >= 4).join(top, "query_id")
    score = 1.2 * F.size(F.filter("tokens", lambda t: F.array_contains(F.col("top"), t))) + 1.1 * F.regexp_count("sentence", F.lit(NUMBER)) + 0.1 * F.size(F.array_distinct("tokens"))
    sents = sents.withColumn("score", F.round(score, 6)).withColumn("norm", F.regexp_replace(F.lower("sentence"), "^[ .]+|[ .]+$", ""))
    first = F.row_number().over(Window.partitionBy("query_id", "norm").orderBy("rank", "pos"))
    sents = sents.withColumn("nth", first).filter("nth = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "pos"))
    return sents.withColumn("place", place).filter(F.col("place") <= limit).select("query_id", "place", "sentence", "score")


#: How the charts and metrics of a fact sheet are named.
CHARTS = {"bar_chart": ("График 1", "Категория", "Значение", "Распределение по категориям"), "pie_chart": ("График 2", None, None, "Доли категорий"), "line_chart": ("График 3", "Шаг", "Значение", "Динамика показателя")}
METRICS = (("chunks", "шт", "Количество отобранных фрагментов контекста."), ("sources", "шт", "Число источников в выборке."), ("mean_score_percent", "%", "Средний интегральный score по retrieval."), ("numbers", "шт", "Количество обнаруженных числовых упоминаний."))


def points(rows: DataFrame, prefix: str, cut: int, least: int, name: str) -> DataFrame:
    """query_id, data: rows (query_id, place, name, value) as numbered points, names to `cut` characters, filled up to `least`."""
    one = F.struct("place", F.struct(point_id(prefix, F.col("place")).alias("id"), short_text(F.col("name"), cut).alias("name"), F.col("value").cast("double").alias("value")).alias("p"))
    data = rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["p"]).alias("data"))
    return data.select("query_id", padded_points(F.col("data"), prefix, least, name).alias("data"))


def bar_points(results: DataFrame, most: int = 6) -> DataFrame:
    return points(theme_shares(results, most), "bar", 48, 4, "Тема")


def pie_points(results: DataFrame) -> DataFrame:
    return points(source_shares(results), "pie", 32, 3, "Источник")


def line_points(results: DataFrame, most: int = 6) -> DataFrame:
    named = score_line(results, most).select("query_id", F.col("rank").alias("place"), F.concat(F.lit("Чанк "), F.col("rank").cast("string")).alias("name"), "value")
    return points(named, "line", 48, 4, "Чанк")


def source_scores(results: DataFrame) -> DataFrame:
    """query_id, source, score (sum), chunks."""
    return scored(results).groupBy("query_id", "source").agg(F.round(F.sum("s"), 9).alias("score"), F.count("*").alias("chunks"))


def payload(results: DataFrame, most: int = 6, require_cyrillic: bool = True) -> DataFrame:
    """query_id, facts: the fact sheet of each query's results (query_id, rank, source_name, score, text), as a struct.

    Four metrics; themes, sources and scores as charts of up to `most` points, held in 4 .. 12, filled up with zeros; the
    best sentences as insights, and, under three, what charts and metrics say. Queries without a result have no row.
    """
    most = min(12, max(4, most))
    results = stored(results.select("query_id", "rank", "source_name", "score", "text"), "results")
    m = metrics(results)
    name = lambda i: F.lit(f"Показатель {i}").alias("name")
    said = [F.struct(F.lit(f"metric-{i}").alias("id"), name(i), F.col(c).cast("string").alias("value"), F.lit(u).alias("unit"), F.lit(t).alias("description")) for i, (c, u, t) in enumerate(METRICS, 1)]
    rows = m.select("query_id", "chunks", "mean_score_percent", F.array(*said).alias("metrics"))
    for chart, data in (("bar_chart", bar_points(results, most)), ("pie_chart", pie_points(results)), ("line_chart", line_points(results, most))):
        rows = rows.join(data.withColumnRenamed("data", chart), "query_id", "left")
    best = insights(results, 5, require_cyrillic).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]).alias("found"))
    rows = rows.join(best, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    # A query whose texts hold no theme has the zero points alone.
    none = F.array().cast("array<struct<id:string,name:string,value:double>>")
    for chart, prefix, least, label in (("bar_chart", "bar", 4, "Тема"), ("pie_chart", "pie", 3, "Источник"), ("line_chart", "line", 4, "Чанк")):
        rows = rows.withColumn(chart, padded_points(F.coalesce(chart, none), prefix, least, label))
    bars = F.col("bar_chart")
    more = F.array(
        F.format_string("Ключевая тема контекста: %s (%.1f%% тематического веса).", bars[0]["name"], bars[0]["value"]),
        F.concat(F.lit("В документе доминируют темы: "), F.array_join(F.transform(F.slice(bars, 1, 3), lambda p: p["name"]), ", "), F.lit(".")),
        F.format_string("Средний релевантный score составляет %.1f%%, анализ охватывает %d чанков.", "mean_score_percent", "chunks"),
    )
    said = F.when(F.size("found") < 3, F.slice(F.concat("found", more), 1, 5)).otherwise(F.col("found"))

    def chart(c: str) -> Column:
        title, x, y, legend = CHARTS[c]
        axes = [F.lit(x).alias("x_axis_label"), F.lit(y).alias("y_axis_label")] if x else []
        return F.struct(F.lit(title).alias("title"), *axes, F.lit(legend).alias("legend"), F.col(c).alias("data")).alias(c)

    return rows.select("query_id", F.struct(F.lit("Инфографика").alias("title"), F.lit("Агрегированный контекст источников").alias("subtitle"), "metrics", *map(chart, CHARTS), said.alias("key_insights")).alias("facts"))
