"""Requests of backends, and words against the rules of their suffixes."""

import os
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators import generate
from folioforge.operators.generate import Backends


def test_one_client_a_task_and_bounded_requests(spark, tmp_path):
    folder = str(tmp_path)

    def opened():
        with open(f"{folder}/client-{uuid.uuid4().hex}", "w") as f:
            f.write(str(os.getpid()))

        def asked(batch):
            with open(f"{folder}/request-{uuid.uuid4().hex}", "w") as f:
                f.write(f"{len(batch)} {sum(map(len, batch))}")
            return [f" {len(t)} " for t in batch]

        return Backends(text=asked, vectors=lambda b: [[float(len(t))] for t in asked(b) and b])

    rows = spark.range(3000).select("id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("t")).union(spark.range(1).select(F.lit(5000).alias("id"), F.repeat(F.lit("y"), F.lit(2000)).alias("t"))).coalesce(2)
    b = Backends(opened=opened, most_texts=100, most_characters=1000)
    for made in (generate.generate(rows, F.col("t"), backends=b), generate.embed(rows, "t", "answer", b)):
        for f in os.listdir(folder):
            os.unlink(f"{folder}/{f}")
        got = {r.id: r.answer for r in made.collect()}
        assert all(float(v if isinstance(v, str) else v[0]) == (2000 if k == 5000 else k % 50) for k, v in got.items()) and len(got) == 3001
        sizes = [tuple(map(int, open(f"{folder}/{f}").read().split())) for f in os.listdir(folder) if f.startswith("request")]
        assert sum(f.startswith("client") for f in os.listdir(folder)) == 2
        assert all(n <= 100 and (size <= 1000 or n == 1) for n, size in sizes) and sum(n for n, _ in sizes) == 3001


def test_too_few_answers_are_a_failure(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    few = Backends(text=lambda b: ["one"], tries=1)
    with pytest.raises(Exception, match="1 answers to 2 texts"):
        generate.generate(rows, F.col("t"), backends=few).collect()
    assert {r.answer for r in generate.or_else(rows, F.col("t"), F.lit("else"), "answer", Backends(text=lambda b: [], tries=1)).collect()} == {"else"}

    def never():
        raise OSError

    assert {r.answer for r in generate.or_else(rows, F.col("t"), F.lit("else"), "answer", Backends(opened=never)).collect()} == {"else"}


def stem_by_hand(word):
    low = word.lower().replace("ё", "е")
    if len(low) < 6:
        return low
    for suffixes in (text.RU_SUFFIXES, text.EN_SUFFIXES):
        ends = [s for s in suffixes if low.endswith(s) and len(low) - len(s) >= 4]
        if ends:
            low = low[: len(low) - max(map(len, ends))]
    return low


def test_stems(spark):
    r = random.Random(2)
    words = ["running", "classes", "tested", "quickly", "boxes", "bring", "stings", "моделями", "данных", "индексиями", "ёлками", "abcdы", "abcdefы", "словаing"]
    for _ in range(1500):
        base = "".join(r.choice("abдежing") for _ in range(r.randrange(1, 8)))
        words.append(base + r.choice([*text.RU_SUFFIXES, *text.EN_SUFFIXES, ""]) + r.choice(["", "", *text.EN_SUFFIXES]))
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    assert [x.s for x in df.select("i", text.stem(F.col("w")).alias("s")).orderBy("i").collect()] == [stem_by_hand(w) for w in words]


def test_clean_tokens_and_noise(spark):
    def clean(w):
        latin, cyrillic = re.search("(?i)[a-z]", w), re.search("(?i)[а-яё]", w)
        odd = re.search("(?i)[ьъэ]{2}", w) or re.search("(?i)[a-z][ьъэ]|[ьъэ][a-z]", w)
        return len(w) >= 3 and not (latin and cyrillic) and not odd and not (len(w) <= 4 and not re.search("(?i)[aeiouyаеёиоуыэюя]", w))

    words = ["ab", "abc", "bcd", "bcdf", "bcdfg", "мир", "мрк", "миr", "объём", "ъъа", "эьа", "aьb", "ДОМ", "ЪЬ", "x1", "123", "1234", "12345"]
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    assert [x.s for x in df.select("i", text.clean_token(F.col("w")).alias("s")).orderBy("i").collect()] == [bool(clean(w)) for w in words]
    texts = ["plain  text\tof words", "Глава ....... 12\nдальше", "line .... 5 x", "это аъб слово", "ТЕЭ и Ъ", "a....\n5"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, w string")
    got = [x.s for x in df.select("i", text.clean_ocr_noise(F.col("w")).alias("s")).orderBy("i").collect()]
    # Each step for itself, word by word and line by line.
    want = []
    for t in texts:
        t = re.sub(r"[^\S\r\n]+", " ", t)
        lines = ["" if re.fullmatch(r".*\.{4,}\s*\d+\s*", x) else x for x in t.split("\n")]
        t = "\n".join(lines) if not re.search(r"\.{4,}\n\d+\s*$", t) else ""
        want.append("".join(" " if re.fullmatch("(?i)[а-яёa-z]{1,3}[эьъ][а-яёa-z]{0,3}", w) else w for w in re.split(r"(\w+)", t)))
    assert got == want
