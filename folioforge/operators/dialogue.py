"""Two-speaker dialogues: normalising answers, making one of free text, segments for speech."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_END, PACES, TONES, WS, nonblank, prepared_source, squeeze, strip, tts_text
from .generate import Backends, generate

#: What a line of a dialogue begins with.
HOSTS = ("Ведущий 1:", "Ведущий 2:")
LEAST = 6


@dataclass(frozen=True)
class DialogueConfig:
    """tone and pace by their own names, see normalize_tone and normalize_pace for synonyms."""

    tone: str = "scientific"
    pace: str = "normal"

    def __post_init__(self):
        if self.tone not in TONES or self.pace not in PACES:
            raise ValueError(f"unknown tone or pace: {self.tone}, {self.pace}")


def normalized(raw: Column) -> Column:
    """Lines of the two hosts ("Speaker 1:" and "Speaker 2:", so written, are rewritten); under six lines, the empty text."""
    named = lambda s, n: F.when(s.startswith(f"Speaker {n}:"), F.concat(F.lit(HOSTS[n - 1]), F.substring(s, len(f"Speaker {n}:") + 1, 1 << 30)))
    lines = F.transform(nonblank(F.split(raw, LINE_END)), lambda s: F.coalesce(named(s, 1), named(s, 2), s))
    lines = F.filter(lines, lambda s: s.startswith(HOSTS[0]) | s.startswith(HOSTS[1]))
    return F.when(F.size(lines) >= LEAST, F.array_join(lines, "\n")).otherwise("")


def coerced(raw: Column) -> Column:
    """Sentences of free text, of eight characters and more without the quotes at their ends, spoken in turn; under six, the empty text."""
    parts = nonblank(F.split(squeeze(raw), "(?<=[.!?]) +"))
    spoken = F.filter(F.transform(parts, lambda s: F.regexp_replace(s, "^[ \"']+|[ \"']+$", "")), lambda s: F.length(s) >= 8)
    lines = F.transform(spoken, lambda s, i: F.concat(F.when(i % 2 == 0, HOSTS[0]).otherwise(HOSTS[1]), F.lit(" "), s))
    return F.when((F.size(parts) >= LEAST) & (F.size(lines) >= LEAST), F.array_join(lines, "\n")).otherwise("")


def low_quality(dialogue: Column) -> Column:
    lines = nonblank(F.split(dialogue, LINE_END))
    return (F.size(lines) < LEAST) | ~F.exists(lines, lambda s: s.startswith(HOSTS[0])) | ~F.exists(lines, lambda s: s.startswith(HOSTS[1]))


def segments(df: DataFrame, key: str, dialogue: Column) -> DataFrame:
    """key, line_no, speaker (1 or 2), text of the lines of a host, and spoken, what speech falls back on (see tts_text)."""
    rows = df.select(key, F.posexplode(nonblank(F.split(dialogue, LINE_END))).alias("line_no", "line"))
    said = f"^Ведущий{WS}*([12]){WS}*:{WS}*(.+)$"
    rows = rows.filter(F.col("line").rlike(said)).select(key, "line_no", F.regexp_extract("line", said, 1).cast("int").alias("speaker"), strip(F.regexp_extract("line", said, 2)).alias("text"))
    return rows.select("*", tts_text(F.col("text")).alias("spoken"))


def generated(docs: DataFrame, config: DialogueConfig, backends: Backends, topic: str = "Без названия") -> DataFrame:
    """docs with dialogue: the text model's answer to the prepared source, as lines of two hosts, else coerced; an answer that gives none is an error.

    A text of which nothing is left is an error too. Tone and pace go into the prompt.
    """
    source = prepared_source(F.col("text"))
    checked = F.when(strip(source) == "", F.raise_error(F.lit("empty text for a dialogue")).cast("string")).otherwise(source)
    prompt = F.concat(F.lit(f"Write a dialogue of two hosts about the text, 30 to 35 short lines, each begins with '{HOSTS[0]}' or '{HOSTS[1]}'.\nTone: {config.tone}\nPace: {config.pace}\nTopic: {topic}\n\n"), checked)
    rows = generate(docs, prompt, "dialogue", backends)
    said = F.when(normalized(F.col("dialogue")) != "", normalized(F.col("dialogue"))).otherwise(coerced(F.col("dialogue")))
    return rows.withColumn("dialogue", said).withColumn("dialogue", F.when(low_quality(F.col("dialogue")), F.raise_error(F.lit("the model's answer is no dialogue")).cast("string")).otherwise(F.col("dialogue")))
