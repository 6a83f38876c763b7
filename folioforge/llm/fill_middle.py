"""Operator 11: fill-in-the-middle transformation, its units cut by zero-width boundaries in Spark's split."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Documents of a hundred that stay plain, and those of a hundred others whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20


@dataclass(frozen=True)
class Units:
    """A unit grammar by classes of neighbouring characters.

    runs: bodies of disjoint character classes; neighbours of one class belong to one unit, any other character is a
    unit of its own. closed_by: instead, a unit ends behind a character of this class.
    """

    runs: tuple[str, ...] = ()
    closed_by: str = ""

    def boundary(self) -> str:
        """A regular expression of no width that matches between two units, never at an end of the text.

        It looks at the two neighbouring characters alone: behind a run's class it wants one outside of it, behind any
        other character it wants just any.
        """
        follows = r"(?=[\s\S])"
        if self.closed_by:
            return f"(?<=[{self.closed_by}]){follows}"
        behind = [f"(?<=[{r}])(?=[^{r}])" for r in self.runs]
        single = f"(?<=[^{''.join(self.runs)}])" if self.runs else r"(?<=[\s\S])"
        return "|".join([*behind, single + follows])


CHARACTERS = Units()
WORDS = Units(runs=("A-Za-z",))
WORDS_AND_BLANKS = Units(runs=("A-Za-z", "0-9", r"\x20\x09-\x0D"))
LINES = Units(closed_by=r"\n")


def checked_marks(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that can be found again next to any text: none begins with another one's end, none is in another one."""
    p = tuple(marks)
    if len(set(p)) != 3 or not all(p):
        raise ValueError("three different marks are needed")
    for a in p:
        for b in p:
            if any(b.startswith(a[-k:]) for k in range(1, len(a))) or (a != b and a in b):
                raise ValueError(f"marks {a} and {b} can overlap")
    return p


def _draws(doc_id: Column, seed: str) -> list[Column]:
    """Four whole numbers below 2^32 from the SHA-256 of seed, colon and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, units: Units = WORDS, marks: tuple[str, str, str] = MARKS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, seed: str = "1") -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix, output of every whole text; the three parts are null in form plain.

    Two draws of the document's hash give the units behind which prefix and middle end, two more its form: plain (the
    text as it is), psm (mark and prefix, mark and suffix, mark and middle) or spm (suffix before prefix). All of it is
    Column expressions: Spark's split cuts a text at its boundaries and keeps every piece, so no row leaves the JVM
    and nothing is shuffled. While a text is cut, its task holds some 100 bytes a unit.

    Cases: a null or empty text has no unit and is plain; one that contains a mark is plain, so that marks can be
    found again; a null doc_id stays null and draws as the empty string; repeated rows give repeated rows; an empty
    table gives none; other columns are not read.
    """
    p, s, m = checked_marks(marks)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array(*_draws(F.col("doc_id"), seed)).alias("h"))
    cut = F.split("text", units.boundary(), -1)
    rows = rows.select("doc_id", "text", "h", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(cut).alias("units"))
    n, h = F.size("units").cast("long"), lambda k: F.col("h")[k]
    ends = [h(k) % (n + 1) for k in (0, 1)]
    stays = (F.col("text") == "") | F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m) | (h(2) % 100 >= 100 - plain)
    form = F.when(stays, "plain").when(h(3) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", n.alias("n"), F.least(*ends).cast("int").alias("first"), F.greatest(*ends).cast("int").alias("last"), form.alias("form"))
    part = lambda begin, end: F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, end - begin), ""))
    first, last = F.col("first"), F.col("last")
    rows = rows.select("doc_id", "text", "n", "form", part(F.lit(0), first).alias("prefix"), part(first, last).alias("middle"), part(last, F.col("n").cast("int")).alias("suffix"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"))
    output = output.otherwise(F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """rows (with output and form) and restored: the text, from those two alone. The output is cut at the marks, which the text does not contain."""
    parts = free_name(rows, "parts")
    rows = rows.withColumn(parts, F.split("output", "|".join(map(re.escape, checked_marks(marks))), -1))
    back = lambda *order: F.concat(*(F.get(parts, F.lit(k)) for k in order))
    return rows.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", back(1, 3, 2)).otherwise(back(2, 3, 1))).drop(parts)
