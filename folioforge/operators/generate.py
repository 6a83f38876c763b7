"""Answers, summaries, flashcards, slides, tables and embeddings by exchangeable backends; the defaults work offline and are deterministic."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structured
from ..functions.columns import bound
from ..functions.text import WS, model_prefix, nonblank, short_text, shorten, squeeze, strip
from ..storage import stored
from . import facts, retrieval

Texts = Callable[[list[str]], list[str]]
Vectors = Callable[[list[str]], list[list[float]]]


def hashed_vectors(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Hashed bags of words of unit length."""
    out = []
    for t in texts:
        v = [0.0] * dim
        for w in t.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out


def _sentences(text: str) -> list[str]:
    return [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]


def first_sentences(prompts: list[str], most: int = 3) -> list[str]:
    """The first sentences of a prompt's last paragraph."""
    return [" ".join(_sentences(p.rsplit("\n\n", 1)[-1])[:most]) for p in prompts]


def best_sentences(prompts: list[str], most: int = 3) -> list[str]:
    """Of the first block of the context, the best-ranked one, the sentences with the most words of the question, in their order.

    A prompt is instructions with a line "Question: ...", and behind a blank line the context, whose blocks begin with a line in brackets.
    """
    out = []
    for p in prompts:
        head, _, context = p.partition("\n\n")
        asked = set(re.findall(r"\w+", head.rpartition("Question:")[2].lower()))
        block = re.split(r"\n\n(?=\[)", context.strip())[0]
        said = _sentences(block.partition("\n")[2] if block.startswith("[") else block)
        order = sorted(range(len(said)), key=lambda i: (-len(asked & set(re.findall(r"\w+", said[i].lower()))), i))[:most]
        out.append(" ".join(said[i] for i in sorted(order)))
    return out


def sentence_table(prompts: list[str], most: int = 20) -> list[str]:
    """JSON of a table of the last paragraph's "name: value" lines, or else of its sentences."""
    out = []
    for p in prompts:
        lines = [x.strip() for x in p.rsplit("\n\n", 1)[-1].splitlines() if x.strip()]
        named = [x.partition(":")[::2] for x in lines if ":" in x]
        rows = [[k.strip(), v.strip()] for k, v in named] or [[x] for x in _sentences(" ".join(lines))[:most]]
        out.append(json.dumps({"title": "", "columns": ["name", "value"] if named else ["sentence"], "rows": rows}, ensure_ascii=False))
    return out


@dataclass(frozen=True)
class Backends:
    """What stands behind models: text generation and embeddings, each by requests of strings; tried `tries` times.

    A request has at most most_texts strings of most_characters in all, or one string. Where opened is given, it makes
    the backends that are asked, once in each task: a client with its connections, which cannot be sent there.
    """

    text: Texts = first_sentences
    vectors: Vectors = hashed_vectors
    tries: int = 4
    most_texts: int = 256
    most_characters: int = 400_000
    opened: Callable[[], Backends] | None = None

    def live(self) -> Backends:
        return self if self.opened is None else replace(self.opened(), tries=self.tries, most_texts=self.most_texts, most_characters=self.most_characters, opened=None)

    def requests(self, batch: list[str]) -> Iterator[list[str]]:
        held, size = [], 0
        for t in batch:
            if held and (len(held) >= self.most_texts or size + len(t) > self.most_characters):
                yield held
                held, size = [], 0
            held.append(t)
            size += len(t)
        if held:
            yield held

    def all(self, call: Callable, batch: list[str]) -> list:
        """What a call gives to all strings, request by request; another number of answers than of strings is a failure."""

        def whole(part: list[str]) -> list:
            out = list(call(part))
            if len(out) != len(part):
                raise RuntimeError(f"{len(out)} answers to {len(part)} texts")
            return out

        return [x for part in self.requests(batch) for x in self.again(whole, part)]

    def again(self, call: Callable, batch: list[str]):
        for n in range(self.tries):
            try:
                return call(batch)
            except Exception:  # noqa: BLE001 - services fail in many ways; the last failure is raised
                if n == self.tries - 1:
                    raise
                time.sleep(1.5 * 2**n)
        raise AssertionError


OFFLINE = Backends()


def base_url(url: str) -> str:
    """A service's address with its version at the end."""
    url = url.rstrip("/")
    return url if url.endswith("/v1") else url + "/v1"


def resolved_key(given: str | None, names: tuple[str, ...] = ()) -> str | None:
    """The key that is given, else the first of the environment variables that holds one."""
    return given or next((v for n in names if (v := os.environ.get(n))), None)


def resolved_models(requested: str | None, configured: str = "", default: str = "default", most: int = 8) -> list[str]:
    """Models to ask, without repeats, in the order requested, configured, default; at least one, at most `most`."""
    named = [m.strip() for text in (requested or "", configured) for m in re.split("[,;]", text)]
    return list(dict.fromkeys(m for m in [*named, default] if m))[: max(1, most)] or [default]


def service_vectors(url: str, model: str, key: str | None = None, timeout: float = 120.0) -> Vectors:
    """Vectors of an embedding service that takes {model, input} and gives {data: [{embedding}]}; a key is needed."""
    if not (key := resolved_key(key, ("OPENAI_API_KEY",))):
        raise RuntimeError("an embedding service needs a key")

    def call(texts: list[str]) -> list[list[float]]:
        return [x["embedding"] for x in _posted(f"{base_url(url)}/embeddings", {"model": model, "input": texts}, key, timeout)["data"]]

    return call


def service_text(url: str, model: str, key: str | None = None, system: str = "", temperature: float = 0.3, max_tokens: int = 4096, timeout: float = 180.0) -> Texts:
    """Answers of a chat service, one request a prompt."""
    if not (key := resolved_key(key, ("OPENAI_API_KEY",))):
        raise RuntimeError("a chat service needs a key")

    def call(prompts: list[str]) -> list[str]:
        ask = lambda p: {"model": model, "messages": [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": p}], "temperature": temperature, "max_tokens": max_tokens}
        return [(_posted(f"{base_url(url)}/chat/completions", ask(p), key, timeout)["choices"][0]["message"]["content"] or "").strip() for p in prompts]

    return call


def _posted(url: str, body: dict, key: str, timeout: float) -> dict:
    from urllib.request import Request, urlopen

    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def embed(df: DataFrame, text: str, out: str = "embedding", backends: Backends = OFFLINE, model: str = "", is_query: bool = False) -> DataFrame:
    """df with vectors of a text column, null as empty; models of the e5 family get their prefix."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        live = backends.live()
        for t in batches:
            yield pd.Series(live.all(live.vectors, t.fillna("").tolist()), dtype=object)

    return df.withColumn(out, vectors(model_prefix(F.coalesce(F.col(text), F.lit("")), model, is_query)))


def generate(df: DataFrame, prompt: Column, out: str = "answer", backends: Backends = OFFLINE) -> DataFrame:
    """df with the text model's answer to each prompt, stripped; a null prompt is an empty one."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        live = backends.live()
        for p in batches:
            yield pd.Series([a.strip() for a in live.all(live.text, p.fillna("").tolist())], dtype=object)

    return df.withColumn(out, texts(prompt))


def or_else(df: DataFrame, prompt: Column, fallback: Column, out: str, backends: Backends = OFFLINE) -> DataFrame:
    """generate, but a prompt whose call fails, or whose answer is blank, has the fallback."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        live = None

        def one(prompt: str) -> str | None:
            nonlocal live
            try:
                live = live or backends.live()
                return live.all(live.text, [prompt])[0].strip() or None
            except Exception:  # noqa: BLE001 - whatever a backend raises, the row has its fallback
                return None

        for p in batches:
            yield pd.Series([one(x) for x in p.fillna("")], dtype=object)

    return df.withColumn(out, F.coalesce(texts(prompt), fallback))


def ask(contexts: DataFrame, question: str = "query_text", backends: Backends = Backends(text=best_sentences)) -> DataFrame:
    """Answers to questions from their contexts only. Offline: sentences of the best-ranked block."""
    prompt = F.concat(F.lit("Answer from the context only.\nQuestion: "), F.col(question), F.lit("\n\n"), F.col("context"))
    return generate(contexts, prompt, backends=backends)


def summarize(docs: DataFrame, most_sentences: int = 10, backends: Backends = OFFLINE, topic: str = "", template: str | None = None, blank: str = "Текст пуст.") -> DataFrame:
    """docs with summary: of the first 9,000 characters; the number of sentences is held in 3 .. 100.

    A template with {text} takes the place of the prompt, one without goes before the text; {topic} and
    {max_sentences} are filled in. A blank text has a fixed summary, an empty answer is an error, and a leading label is cut off.
    """
    n = min(100, max(3, most_sentences))
    text = F.substring(squeeze(F.coalesce("text", F.lit(""))), 1, 9000)
    if template is None:
        prompt = F.concat(F.lit(f"Summarise in at most {n} sentences.{' Topic: ' + topic if topic else ''}\n\n"), text)
    else:
        filled = template.replace("{topic}", topic).replace("{max_sentences}", str(n))
        before, _, after = filled.partition("{text}") if "{text}" in filled else (filled + "\n\n", "", "")
        prompt = F.concat(F.lit(before), text, F.lit(after))
    rows = generate(docs, prompt, "summary", backends)
    said = strip(F.regexp_replace("summary", "(?iu)^(?:summary|резюме|саммари)\\s*:\\s*", ""))
    checked = F.when(said == "", F.raise_error(F.lit("the model's summary is empty")).cast("string")).otherwise(said)
    return rows.withColumn("summary", F.when(text == "", F.lit(blank)).otherwise(checked))


def extract_table(docs: DataFrame, hint: str = "", backends: Backends = Backends(text=sentence_table)) -> DataFrame:
    """docs with table, struct<title, columns, rows>: a table of the text; a blank text, and an answer that is no table, are errors."""
    text = F.when(strip(F.coalesce("text", F.lit(""))) == "", F.raise_error(F.lit("the text is empty")).cast("string")).otherwise(F.col("text"))
    ask_ = f"Turn the text into a table. Answer with JSON only: {{\"title\": \"...\", \"columns\": [\"...\"], \"rows\": [[\"...\"]]}}.{' Hint: ' + hint if hint else ''}\n\n"
    rows = generate(docs, F.concat(F.lit(ask_), text), "table", backends).withColumn("table", structured.table_object(F.col("table"), structured.TABLE))
    return rows.withColumn("table", structured.normalized_table(F.col("table.columns"), F.col("table.rows"), F.col("table.title")))


def flash_materials(docs: DataFrame, cards: int = 10, tests: int = 5, topic: str = "Без названия", language: str = "ru", backends: Backends | None = None) -> DataFrame:
    """docs with pack, struct<flashcards, tests>, from the first 18,000 characters; offline, cards of left-out words and tests of the same words.

    An answer that is no JSON object is an error.
    """
    text = F.substring(F.coalesce("text", F.lit("")), 1, 18_000)
    if backends is None:
        return docs.withColumn("pack", _offline_pack(text, cards, tests))
    ask_ = f"Topic: {topic}\nLanguage: {language}\nMake {cards} flashcards (question, answer) and {tests} tests (question, 4 options, correct_index, explanation) from the context only. Answer with JSON only: {{\"flashcards\": [...], \"tests\": [...]}}\n\n"
    rows = generate(docs, F.concat(F.lit(ask_), text), "pack", backends).withColumn("pack", structured.cards_object(F.col("pack"), structured.PACK))
    checked = F.when(F.col("pack").isNull(), F.raise_error(F.lit("the answer is no JSON object")).cast("struct<flashcards:array<struct<question:string,answer:string>>,tests:array<struct<question:string,options:array<string>,correct_index:string,explanation:string>>>")).otherwise(F.col("pack"))
    return rows.withColumn("pack", structured.flash_pack(checked))


def _left_out(text: Column, most: int) -> Column:
    """array<struct<question, answer>>: the first `most` sentences of forty characters and more, each without its longest word, and that word."""
    sents = F.slice(F.filter(F.transform(F.split(text, f"(?<=[.!?]){WS}+|\n+"), strip), lambda s: F.length(s) >= 40), 1, most)
    word = lambda s: F.array_max(F.transform(F.split(s, f"{WS}+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return F.transform(sents, lambda s: bound(word(s), lambda w: F.struct(F.replace(s, w, F.lit("____")).alias("question"), w.alias("answer"))))


def _offline_pack(text: Column, cards: int, tests: int) -> Column:
    """Cards, and tests whose options are the answers of up to four cards, in the order of the alphabet; a test needs two. As structured.flash_pack gives them: there are no blanks at the ends, and no empty texts."""

    def quiz(made: Column, others: Column) -> Column:
        options = lambda c: F.sort_array(F.array_distinct(F.concat(F.array(c["answer"]), others)))
        test = lambda c, o: F.struct(c["question"].alias("question"), o.alias("options"), (F.array_position(o, c["answer"]) - 1).cast("int").alias("correct_index"), F.lit("").alias("explanation"))
        rows = F.transform(F.slice(made, 1, max(1, tests)), lambda c: bound(options(c), lambda o: test(c, o)))
        return F.filter(rows, lambda t: F.size(t["options"]) >= 2)

    def pack(made: Column) -> Column:
        others = F.slice(F.array_distinct(F.slice(F.transform(made, lambda c: c["answer"]), 1, 4)), 1, 3)
        return F.struct(F.slice(made, 1, max(1, cards)).alias("flashcards"), bound(others, lambda o: quiz(made, o)).alias("tests"))

    return bound(_left_out(text, max(cards, tests, 1)), pack)


def flashcards(docs: DataFrame, most: int = 10) -> DataFrame:
    """Offline question-answer pairs: a sentence with its longest word left out, and that word."""
    cards = _left_out(F.substring("text", 1, 18_000), most)
    # The outer form: before the plain one Spark puts a filter that works the cards out a second time.
    rows = docs.select("doc_id", F.posexplode_outer(cards).alias("pos", "card")).filter(F.col("pos").isNotNull())
    return rows.select("doc_id", "pos", "card.question", "card.answer")


def slide_plan(results: DataFrame, most: int = 8) -> DataFrame:
    """Offline slides: one for each result by rank, its first sentences as bullets, held in 2 .. 15."""
    bullets = F.transform(F.slice(nonblank(F.split("text", f"(?<=[.!?]){WS}+|\n+")), 1, 5), lambda s: shorten(s, 160))
    return results.filter(F.col("rank") <= min(15, max(2, most))).select("query_id", "rank", F.col("source_name").alias("title"), bullets.alias("bullets"), F.array("rank").alias("source_ids"))


def presentation(results: DataFrame, queries: DataFrame, most: int = 8, bullets: int = 5, backends: Backends | None = None) -> DataFrame:
    """query_id, plan, struct<title, slides>, slides_count (with the title's): a model's plan from the numbered results, checked.

    An answer without JSON is an error. Offline there is no plan, so each result gives a slide. Queries without a
    result have no row; the number of slides is held in 2 .. 15.
    """
    most = min(15, max(2, most))
    one = F.struct("rank", F.struct("source_name", "text").alias("r"))
    rows = results.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["r"]).alias("held"))
    if backends is None:
        rows = rows.withColumn("raw", F.from_json(F.lit("{}"), structured.SLIDES))
    else:
        asked = retrieval.numbered_context(results).join(queries.select("query_id", "query_text"), "query_id")
        ask_ = F.concat(F.lit(f'Plan slides from the context only, at most {most} of at most {bullets} bullets. Answer with JSON only: {{"title": "...", "slides": [{{"title": "...", "bullets": ["..."], "source_ids": [1]}}]}}\nQuery: '), F.col("query_text"), F.lit("\n\n"), F.col("context"))
        rows = rows.join(generate(asked, ask_, "answer", backends).select("query_id", "answer"), "query_id")
        rows = rows.withColumn("raw", structured.parsed(F.col("answer"), structured.SLIDES))
        rows = rows.withColumn("raw", F.when(F.col("raw").isNull(), F.raise_error(F.lit("the answer holds no JSON")).cast(structured.SLIDES_TYPE)).otherwise(F.col("raw")))
    # Stored, so that plans of plans do not grow with each use of a parsed answer.
    rows = stored(rows.select("query_id", "held", "raw"), "plans").withColumn("plan", structured.slide_plan(F.col("raw"), F.col("held"), most, bullets))
    return rows.select("query_id", "plan", (F.size("plan.slides") + 1).alias("slides_count"))


def infographic(results: DataFrame, queries: DataFrame, most: int = 6, models: dict[str, Backends] | None = None, require_cyrillic: bool = True) -> DataFrame:
    """query_id, plan, used_chunks, models_used, failed_models: fact sheets, and where models (name -> backends) are given, their checked plans.

    The first model whose answer holds a plan gives it; insights of the later ones go behind. A model that fails, or whose
    answer stays no JSON after one request to repair it, is listed; if all fail, the facts hold.
    """
    sheet = facts.payload(results, most, require_cyrillic)
    rows = sheet.join(results.groupBy("query_id").agg(F.count("*").cast("int").alias("used_chunks")), "query_id")
    if not models:
        return rows.select("query_id", F.col("facts").alias("plan"), "used_chunks", F.array().cast("array<string>").alias("models_used"), F.array().cast("array<string>").alias("failed_models"))
    short = F.struct("rank", F.struct("rank", "source_name", F.round("score", 4).alias("score"), short_text(F.coalesce("text", F.lit("")), 550).alias("text")).alias("r"))
    held = results.groupBy("query_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(short)), lambda x: x["r"])).alias("held"))
    rows = rows.join(held, "query_id").join(queries.select("query_id", "query_text"), "query_id")
    prompt = F.concat(F.lit("Make an infographic of the context. Answer with JSON only, in the form of facts.\nQuery: "), F.col("query_text"), F.lit("\nfacts: "), F.to_json("facts"), F.lit("\n\n"), F.col("held"))
    asked = stored(rows.withColumn("prompt", prompt), "prompts")
    plans, rows = [], asked
    for k, backends in enumerate(models.values()):
        said = or_else(asked.select("query_id", "prompt"), F.col("prompt"), F.lit(None).cast("string"), "answer", backends)
        said = said.withColumn("raw", structured.parsed(F.col("answer"), structured.PLAN)).withColumn("broken", F.col("answer").isNotNull() & F.col("raw").isNull())
        said = stored(said.select("query_id", "answer", "broken"), "answers")
        mend = F.concat(F.lit("Mend this so that it is valid JSON. Answer with JSON only.\n\n"), F.col("answer"))
        again = or_else(said.filter("broken").select("query_id", mend.alias("prompt")), F.col("prompt"), F.lit(None).cast("string"), "answer", backends)
        # Each model's answers are stored and parsed once; a variant has no place in a join's result.
        answers = stored(said.filter("NOT broken").select("query_id", "answer").unionByName(again.select("query_id", "answer")), "answers")
        checked = answers.join(asked.select("query_id", "facts"), "query_id").withColumn("raw", structured.parsed(F.col("answer"), structured.PLAN)).filter(F.col("raw").isNotNull())
        checked = stored(checked.select("query_id", structured.infographic_plan(F.col("raw"), F.col("facts")).alias(f"plan_{k}")), "checked")
        rows = rows.join(checked, "query_id", "left")
        plans.append(F.col(f"plan_{k}"))
    found = F.filter(F.array(*plans), lambda p: p.isNotNull())
    more = F.transform(F.slice(found, 2, len(plans)), lambda p: p["key_insights"])
    first = F.element_at(found, 1)
    merged = F.when(F.size(found) > 0, first.withField("key_insights", structured.merged_insights(first["key_insights"], more))).otherwise(F.col("facts"))
    failed = F.filter(F.array(*(F.when(p.isNull(), F.lit(n)) for p, n in zip(plans, models, strict=True))), lambda n: n.isNotNull())
    return rows.select("query_id", merged.alias("plan"), "used_chunks", F.array(*map(F.lit, models)).alias("models_used"), failed.alias("failed_models"))
