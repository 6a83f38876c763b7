"""Checks and repairs of structured answers (JSON text to typed columns), as Column expressions.

Models are asked for JSON; its schema is a parameter of `parsed`, and each check says what it expects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bound
from .text import has_cyrillic, short_text, strip, to_float

POINT = "struct<id:string,name:string,value:double>"


def json_text(c: Column) -> Column:
    """The JSON text of an answer: a fenced block, else the outermost braces, else brackets; null if there is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces, brackets = F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.coalesce(*(F.when(x != "", x) for x in (fenced, braces, brackets)))


def repaired(c: Column) -> Column:
    """Trailing commas dropped, single quotes made double, line ends made spaces."""
    return F.regexp_replace(F.regexp_replace(F.translate(c, "'\n", "\" "), r",\s*([}\]])", "$1"), "\r", " ")


def parsed(c: Column, schema: str) -> Column:
    """from_json of the answer's JSON text, else of its repair, else null."""
    text = json_text(c)
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema))
    return F.coalesce(valid(text), valid(repaired(text)))


def whole_json(c: Column) -> Column:
    """The text if all of it is one JSON value, else null: what stands behind a value makes it none. Equal keys in an object make it none, too."""
    inside = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit("}"))).isNotNull()
    return F.when(inside, c)


def _object(c: Column) -> Column:
    return F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), c)


def _outermost(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def _unfenced(c: Column) -> Column:
    """Without a fence that begins the answer, and what ends one."""
    c = strip(c)
    return F.when(c.startswith("```"), F.regexp_replace(F.regexp_replace(c, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(c)


def object_alone(c: Column, schema: str) -> Column:
    """from_json of an answer that is one JSON object, a fence around it aside; else null. Nothing is repaired or looked for."""
    return F.from_json(_object(whole_json(_unfenced(c))), schema)


def table_object(c: Column, schema: str) -> Column:
    """from_json of a table's answer: as object_alone, or where all of it is no JSON, what its outermost braces hold; an array is none."""
    t = _unfenced(c)
    whole = whole_json(t)
    return F.from_json(_object(F.when(whole.isNotNull(), whole).otherwise(whole_json(_outermost(t)))), schema)


def cards_object(c: Column, schema: str) -> Column:
    """from_json of a card pack's answer: an object in a fence anywhere, else the answer if it begins with a brace, else what its outermost braces hold."""
    t = strip(c)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    t = F.when(fenced != "", fenced).otherwise(t)
    return F.from_json(_object(whole_json(F.when(t.startswith("{"), t).otherwise(F.coalesce(_outermost(t), t)))), schema)


def point_id(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), n.cast("string"))


def padded_points(points: Column, prefix: str, least: int, name: str) -> Column:
    """Zero points behind, up to `least`."""
    have = F.size(points)
    more = F.transform(F.sequence(have + 1, F.lit(least)), lambda i: F.struct(point_id(prefix, i).alias("id"), F.concat(F.lit(name + " "), i.cast("string")).alias("name"), F.lit(0.0).alias("value")))
    return F.when(have >= least, points).otherwise(F.concat(points, more))


def normalized_points(raw: Column, prefix: str, least: int, most: int, fallback: Column) -> Column:
    """array<struct<id,name,value>> of strings: named points of value 0 and more, names to 48 characters, ids by place where they are missing; too few give the fallback."""
    given = lambda p, i: F.when(F.coalesce(p["id"], F.lit("")) != "", p["id"]).otherwise(point_id(prefix, i + 1))
    rows = F.transform(raw, lambda p, i: F.struct(given(p, i).alias("id"), short_text(F.coalesce(p["name"], F.lit("")), 48).alias("name"), F.round(to_float(p["value"], -1.0), 2).alias("value")))
    rows = F.slice(F.filter(rows, lambda p: (p["name"] != "") & (p["value"] >= 0)), 1, most)
    return F.when(F.size(rows) >= least, rows).otherwise(F.slice(fallback, 1, most))


def normalized_metrics(raw: Column, fallback: Column) -> Column:
    """array<struct<id string, name string, value variant, unit string, description string>>: named metrics with a value, cut to length, at most 8; under two give the fallback.

    A text as value is cut to 24 characters, a number rounded to two places; other values drop the metric. Values come out as text.
    """
    text = lambda c, n: short_text(F.coalesce(c, F.lit("")), n)
    number = lambda v: F.round(F.try_variant_get(v, "$", "double"), 2).cast("string")
    worded = lambda v: short_text(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")), 24)
    value = lambda v: F.when(F.schema_of_variant(v) == "STRING", worded(v)).when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number(v)).when(F.schema_of_variant(v) == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "1.0").otherwise("0.0"))
    given = lambda m, i: F.when(F.coalesce(m["id"], F.lit("")) != "", m["id"]).otherwise(point_id("metric", i + 1))
    rows = F.transform(raw, lambda m, i: F.struct(given(m, i).alias("id"), text(m["name"], 42).alias("name"), value(m["value"]).alias("value"), text(m["unit"], 12).alias("unit"), text(m["description"], 140).alias("description")))
    rows = F.slice(F.filter(rows, lambda m: (m["name"] != "") & (F.coalesce(m["value"], F.lit("")) != "")), 1, 8)
    return F.when(F.size(rows) >= 2, rows).otherwise(fallback)


#: A model's infographic plan as from_json reads it.
CHART = "title string, x_axis_label string, y_axis_label string, legend string, data array<struct<id:string,name:string,value:string>>"
PLAN = f"title string, subtitle string, metrics array<struct<id:string,name:string,value:variant,unit:string,description:string>>, bar_chart struct<{CHART.replace(' string', ':string').replace(' array', ':array')}>, pie_chart struct<{CHART.replace(' string', ':string').replace(' array', ':array')}>, line_chart struct<{CHART.replace(' string', ':string').replace(' array', ':array')}>, key_insights array<string>"


def infographic_plan(raw: Column, facts: Column) -> Column:
    """A model's plan (PLAN) checked against facts (see facts.payload), which stand in for what is missing or unfit.

    Titles and insights need a Cyrillic letter; under two insights or points, those of facts hold.
    """
    label = lambda c, f, n: short_text(F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(f), n)
    title = lambda name, n: F.when(has_cyrillic(short_text(F.coalesce(raw[name], F.lit("")), n)), short_text(raw[name], n)).otherwise(facts[name])

    def chart(name: str, prefix: str, most: int, axes: bool) -> Column:
        mine, theirs = raw[name], facts[name]
        cuts = {"title": 72, **({"x_axis_label": 42, "y_axis_label": 42} if axes else {}), "legend": 140}
        data = normalized_points(F.coalesce(mine["data"], F.array()), prefix, 2, most, theirs["data"])
        return F.struct(*(label(mine[k], theirs[k], n).alias(k) for k, n in cuts.items()), data.alias("data")).alias(name)

    said = F.transform(F.coalesce(raw["key_insights"], F.array()), lambda x: short_text(F.coalesce(x, F.lit("")), 140))
    said = F.slice(F.filter(said, has_cyrillic), 1, 10)
    return F.struct(
        title("title", 90).alias("title"), title("subtitle", 120).alias("subtitle"),
        normalized_metrics(F.coalesce(raw["metrics"], F.array()), facts["metrics"]).alias("metrics"),
        chart("bar_chart", "bar", 12, True), chart("pie_chart", "pie", 10, False), chart("line_chart", "line", 20, True),
        F.when(F.size(said) >= 2, said).otherwise(F.slice(facts["key_insights"], 1, 5)).alias("key_insights"),
    )


def int_ids(raw: Column, most: Column) -> Column:
    """Castable ids in 1 .. most, the first of equal ones."""
    return F.array_distinct(F.filter(F.transform(raw, lambda x: x.try_cast("int")), lambda i: i.between(1, most)))


#: A model's slide plan as from_json reads it.
SLIDES = "title string, slides array<struct<title:string,bullets:array<string>,source_ids:array<string>>>"


SLIDES_TYPE = "struct<title:string,slides:array<struct<title:string,bullets:array<string>,source_ids:array<string>>>>"


def normalized_slides(slides: Column, most: int, bullets: int, sources: Column) -> Column:
    """Of the first `most` slides those with a title and bullets; bullets capped, source ids checked."""
    rows = F.transform(F.slice(slides, 1, most), lambda s: F.struct(strip(F.coalesce(s["title"], F.lit(""))).alias("title"), F.slice(F.filter(F.transform(F.coalesce(s["bullets"], F.array()), lambda b: strip(F.coalesce(b, F.lit("")))), lambda b: b != ""), 1, bullets).alias("bullets"), int_ids(F.coalesce(s["source_ids"], F.array()), sources).alias("source_ids")))
    return F.filter(rows, lambda s: (s["title"] != "") & (F.size(s["bullets"]) > 0))


def slide_plan(raw: Column, results: Column, most: int, bullets: int = 5) -> Column:
    """struct<title, slides>: a model's plan (SLIDES) checked; without a slide, one for each of the first results (array<struct<source_name, text>>) with a text; without these, one that says so."""
    none = F.array().cast("array<int>")
    slides = normalized_slides(F.coalesce(raw["slides"], F.array()), most, bullets, F.size(results))
    texts = F.filter(F.slice(results, 1, most), lambda r: strip(F.coalesce(r["text"], F.lit(""))) != "")
    found = F.transform(texts, lambda r: F.struct(F.coalesce(r["source_name"], F.lit("Источник")).alias("title"), F.array(F.substring(strip(r["text"]), 1, 260)).alias("bullets"), none.alias("source_ids")))
    empty = F.array(F.struct(F.lit("Недостаточно данных").alias("title"), F.array(F.lit("Релевантные источники не найдены")).alias("bullets"), none.alias("source_ids")))
    title = F.when(F.coalesce(raw["title"], F.lit("")) != "", raw["title"]).otherwise(F.lit("Презентация по материалам"))
    return F.struct(title.alias("title"), F.when(F.size(slides) > 0, slides).when(F.size(found) > 0, found).otherwise(empty).alias("slides"))


#: A model's table as from_json reads it.
TABLE = "title string, columns array<string>, rows array<array<string>>"


def normalized_table(columns: Column, rows: Column, title: Column | None = None) -> Column:
    """struct<title, columns, rows>: blank names numbered, values stripped, rows padded or cut to the width; no columns, or no rows at all, is an error."""
    width = F.size(columns)
    names = F.transform(columns, lambda c, i: F.when(strip(F.coalesce(c, F.lit(""))) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(strip(c)))
    fit = F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.slice(F.concat(F.transform(r, lambda v: strip(F.coalesce(v, F.lit("")))), F.array_repeat(F.lit(""), width)), F.lit(1), width))
    head = F.lit("Extracted Table") if title is None else strip(F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.lit("Extracted Table")))
    kind = "struct<title:string,columns:array<string>,rows:array<array<string>>>"
    return F.when((F.coalesce(width, F.lit(-1)) > 0) & rows.isNotNull(), F.struct(head.alias("title"), names.alias("columns"), fit.alias("rows"))).otherwise(F.raise_error(F.lit("the answer has no columns or no rows")).cast(kind))


def sanitized_cards(raw: Column) -> Column:
    rows = F.transform(raw, lambda c: F.struct(strip(F.coalesce(c["question"], F.lit(""))).alias("question"), strip(F.coalesce(c["answer"], F.lit(""))).alias("answer")))
    return F.filter(rows, lambda c: (c["question"] != "") & (c["answer"] != ""))


def sanitized_tests(raw: Column) -> Column:
    """Questions with two options and more; a correct_index out of range is 0."""
    options = lambda t: F.filter(F.transform(F.coalesce(t["options"], F.array()), lambda o: strip(F.coalesce(o, F.lit("")))), lambda o: o != "")
    rows = F.transform(raw, lambda t: F.struct(strip(F.coalesce(t["question"], F.lit(""))).alias("question"), options(t).alias("options"), t["correct_index"].try_cast("int").alias("correct_index"), strip(F.coalesce(t["explanation"], F.lit(""))).alias("explanation")))
    rows = F.filter(rows, lambda t: (t["question"] != "") & (F.size(t["options"]) >= 2))
    good = lambda t: F.coalesce((t["correct_index"] >= 0) & (t["correct_index"] < F.size(t["options"])), F.lit(False))
    return F.transform(rows, lambda t: F.struct(t["question"].alias("question"), t["options"].alias("options"), F.when(good(t), t["correct_index"]).otherwise(0).alias("correct_index"), t["explanation"].alias("explanation")))


#: A model's cards and tests as from_json reads them.
PACK = "flashcards array<struct<question:string,answer:string>>, tests array<struct<question:string,options:array<string>,correct_index:string,explanation:string>>"


def flash_pack(raw: Column) -> Column:
    """struct<flashcards, tests> of a model's answer (PACK), sanitised; what is missing is empty."""
    return bound(raw, lambda r: F.struct(sanitized_cards(F.coalesce(r["flashcards"], F.array())).alias("flashcards"), sanitized_tests(F.coalesce(r["tests"], F.array())).alias("tests")))


def merged_insights(base: Column, others: Column, most: int = 6) -> Column:
    """Insights of later plans that are new go behind, up to `most`; a longer base stays as it is."""
    return F.when(F.size(base) >= most, base).otherwise(F.slice(F.array_distinct(F.concat(base, F.flatten(others))), 1, most))
