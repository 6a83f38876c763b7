"""Rounding and text patterns against plain Python."""

import random
import re

from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.functions.numbers import rounded


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_rounding(spark):
    """Ties in decimal digits, which are mostly no ties of doubles, and real ties, which go to the even neighbour."""
    r = random.Random(1)
    x = [r.randrange(100_000) / 1e5 for _ in range(3000)] + [0.62 * a / 8 + 0.38 * b / 16 for a in range(9) for b in range(17)] + [r.random() * 1000 for _ in range(300)]
    x += [-a / 1e5 for a in range(5, 2000, 10)] + [0.53875, 0.125, 2.5, 1.5, 0.03125, 0.0]
    for places in (0, 2, 3, 4):
        assert values(spark, lambda c: rounded(c, places), [*x, None], "double") == [*(round(v, places) for v in x), None]  # noqa: B023


def low_by_hand(t):
    t = t.strip()
    lines = [x.strip() for x in t.splitlines() if x.strip()]
    toc, numbers = sum(bool(re.search(r"\.{4,}\s*\d{1,3}\s*$", x)) for x in lines), sum(bool(re.fullmatch(r"\d{1,3}", x)) for x in lines)
    return len(t) < 120 or toc >= 2 or toc + numbers >= max(3, len(lines) // 2)


BLANK = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LONG = "word " * 40


def test_low_signal_and_strip(spark):
    ends = ["\n", "\r\n", "\x0b", "\x1c", "\x85", " "]
    texts = [LONG, "1\n2\n3\n" + LONG, *(f"{e}".join(["12", " 7 ", " 999", LONG]) for e in ends), LONG + "\n12\n\n13 \n 14", "12 13 14 " + LONG, "a 1\nb 2\nc 3\n" + LONG]
    texts += ["One ..... 3\nTwo .... 12\n" + LONG, "One ..... 3 x\nTwo .... 12\n" + LONG, BLANK + LONG + BLANK, BLANK, "", "\n" * 3000 + "5\n" + LONG, "1234\n12345\n1\n2\n" + LONG, "x" * 119, "x" * 120]
    assert values(spark, text.low_signal, texts) == [low_by_hand(t) for t in texts]
    assert values(spark, text.strip, texts) == [t.strip() for t in texts]
    assert set(BLANK) == {c for c in map(chr, range(0x11000)) if c.isspace()}


def test_signature_looks_at_as_much_as_it_needs(spark):
    texts = ["A  b\n" * 600, " " * 2000 + "Tail Here", "x" * 799 + "  " * 900 + "Y", "word " * 159 + "abcd" + " " * 2000 + "End", "", "  ", "Ab " * 300]
    want = [" ".join(t.strip().lower().split())[:800] for t in texts]
    assert values(spark, text.signature, texts) == want


def artifacts_by_hand(t):
    """Token by token: hyphens at line ends, runs of three and more single letters, blanks before punctuation."""
    letter = lambda c: len(c) == 1 and (c.isascii() and c.isalpha() or "А" <= c <= "я" or c in "Ёё")
    out = ""
    for i, c in enumerate(t):
        if c in "-\n" and 0 < i < len(t) - 1:
            a = i if c == "-" else i - 1
            if t[a : a + 2] == "-\n" and a > 0 and a + 2 < len(t) and letter(t[a - 1]) and letter(t[a + 2]):
                continue
        out += c
    tokens, blanks = [], []
    for piece in re.split(r"(\s+)", out):
        (blanks if piece.isspace() else tokens).append(piece)
    joined, k = tokens[0], 1
    while k < len(tokens):
        # A run begins behind a blank or at the beginning.
        e = k - 1
        while letter(tokens[e]) and e + 1 < len(tokens) and letter(tokens[e + 1]):
            e += 1
        if letter(tokens[k - 1]) and e - (k - 1) >= 2:
            for j in range(k, e + 1):
                joined += blanks[j - 1].replace(" ", "") + tokens[j]
            k = e + 1
            if k < len(tokens):
                joined += blanks[k - 1] + tokens[k]
                k += 1
            continue
        joined += blanks[k - 1] + tokens[k]
        k += 1
    done, held = "", ""
    for c in joined:
        if c.isspace():
            held += c
        else:
            done += ("" if c in ",.;:!?" else held) + c
            held = ""
    return done + held


def test_artifacts_only_where_there_are_signs(spark):
    texts = ["plain text, no fault.", "exam-\nple", "a b c", "a b cd", "x , y !", "go a b c d end", "a-\n b", "т е к с т и слово", "a b", "a  b\tc d", "end - \n x", "1 2 3", "a b c , d", "-\nx", "one two . three"]
    assert values(spark, text.fix_pdf_artifacts, texts) == [artifacts_by_hand(t) for t in texts]
