"""Text functions as Column expressions: normalisation, sentences, tokens, stems, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space as Python has it (Java's \s is ASCII), and all else.
WS, SOLID = f"[{_BLANKS}]", f"[^{_BLANKS}]"
#: What ends a line, as Python has it.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Word lists, maps and patterns of the behaviour that results must agree with.
LETTER = "[A-Za-zА-Яа-яЁё]"
RU_SUFFIXES = (
    "иями ями ами иях ях ием ем ом ой ий ый ого его ому ему ыми ими ую юю ая яя ое ее ые ие ах ям ам ов ев ей ы и а я е о у ю"
).split()
EN_SUFFIXES = "ing ed ly es s".split()
FACT_STOPWORDS = (
    "это как что или для при без под над после перед про из до мы вы они она оно его ее их наш ваш "
    "который которая которые также чтобы если быть есть был была "
    "the and for with that this from are was were you your"
).split()
GENERIC_WORDS = (
    "это этот эта эти такой такая такое такие какой какая какое какие который которая которое которые потому поэтому также очень просто "
    "пример вопрос ответ данный данная данное данные тема раздел часть уровень случай модель система нужен нужно нужна нужны может могут "
    "будет должен должна должно должны следует является являются использовать использует например именно"
).split()
ENGLISH_STOPWORDS = (
    "the a an and or but if then else for to of on in at by with from as is are was were be been being it this that these those we you "
    "they he she i my your their our not can could will would should about into out up down over under again more most"
).split()
RUSSIAN_STOPWORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему "
    "теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они "
    "тут где есть надо ней для мы тебя их чем была сам чтоб без будто человек чего раз тоже себе под будет ж тогда кто этот того "
    "потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два "
    "об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед "
    "иногда лучше чуть том нельзя такой им более всегда конечно всю между"
).split()
STOPWORDS = [*RUSSIAN_STOPWORDS, *ENGLISH_STOPWORDS]
TONES = {"scientific": "scientific science научный научно", "everyday": "everyday повседневный повседневно popular популярный простыми"}
PACES = {"slow": "slow медленно", "normal": "normal нормально", "fast": "fast быстро"}


#: Characters that stand for Cyrillic letters in broken PDF fonts, in the order of the letters, without the one that no character stands for.
SUBSTITUTES = "\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f!\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNO"
SUBSTITUTED = "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮабвгдежзийклмнопрстуфхцчшщъыьэюя"


#: The same white space, character by character.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """No white space at the ends."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def nonblank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(F.translate(c, "\xa0", " "), "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def decode_substitution(c: Column) -> Column:
    """Map whole tokens back to Cyrillic if at least 3 and 55 % of their characters are stand-ins; links and paths stay."""

    def decoded(token: Column) -> Column:
        hits = F.length(token) - F.length(F.translate(token, SUBSTITUTES, ""))
        keep = (hits < 3) | (hits / F.length(token) < 0.55) | token.contains("/") | F.lower(token).contains("http")
        return F.when(keep, token).otherwise(F.translate(token, SUBSTITUTES, SUBSTITUTED))

    parts = F.regexp_extract_all(c, F.lit(f"({SOLID}+|{WS}+)"), 1)
    # Texts without three stand-ins in a row of solid characters have no token to map.
    some = "[" + "".join(f"\\x{ord(x):02x}" for x in SUBSTITUTES) + "]"
    return F.when(c.rlike(f"{some}(?:{SOLID}*?{some}){{2}}"), F.array_join(F.transform(parts, decoded), "")).otherwise(c)


def fix_pdf_artifacts(c: Column) -> Column:
    """Join hyphenated line ends, collapse spaced-out letters (runs of three and more), drop blanks before punctuation.

    A run takes what it has read for good, so texts of any length need no stack: each further letter has its border in
    the repeated part. Texts without the sign of a fault (a hyphen at a line's end, three single letters, a blank before
    punctuation) are not rewritten.
    """
    only = lambda c, sign, fixed: F.when(sign, fixed).otherwise(c)
    c = only(c, c.contains("-\n"), F.regexp_replace(c, f"({LETTER})-\n({LETTER})", "$1$2"))
    run = f"{LETTER}(?:{WS}++{LETTER}(?={WS}|$)){{2,}}+"
    marked = F.regexp_replace(c, f"(?:(?<={WS})|^)({run})", "\ufdd0$1\ufdd1")
    parts = F.transform(F.split(marked, "[\ufdd0\ufdd1]"), lambda s, i: F.when(i % 2 == 1, F.replace(s, F.lit(" "), F.lit(""))).otherwise(s))
    c = only(c, c.rlike(f"(?:{WS}|^){LETTER}{WS}++{LETTER}{WS}"), F.array_join(parts, ""))
    return only(c, c.rlike(f"{WS}[,.;:!?]"), F.regexp_replace(c, f"(?<!{WS}){WS}++([,.;:!?])", "$1"))


def normalize_text(c: Column, decode_cyrillic: bool = True) -> Column:
    return normalize_whitespace(fix_pdf_artifacts(decode_substitution(c) if decode_cyrillic else c))


def split_sentences(c: Column) -> Column:
    """Paragraphs at blank lines, sentences after . ! ?; blank ones are dropped."""
    return nonblank(F.flatten(F.transform(F.split(c, "\n{2,}"), lambda p: F.split(p, f"(?<=[.!?]){WS}+"))))


def sentences(c: Column) -> Column:
    """Sentences after . ! ? or at line ends."""
    return nonblank(F.split(c, f"(?<=[.!?]){WS}+|\n+"))


def low_signal(c: Column) -> Column:
    """Short texts, tables of contents and page-number lists. Lines are gone through once, and only where one of them can be of such a kind."""
    c = strip(c)
    count = lambda s, name, flag: (s[name] + flag.cast("int")).alias(name)
    toc, number, solid = rf"(?<!\.)\.{{4,}}+{WS}*+\d{{1,3}}{WS}*+$", rf"^{WS}*\d{{1,3}}{WS}*$", SOLID
    start = F.struct(*(F.lit(0).alias(n) for n in ("lines", "toc", "numbers")))
    step = lambda s, line: F.struct(count(s, "lines", line.rlike(solid)), count(s, "toc", line.rlike(toc)), count(s, "numbers", line.rlike(number)))
    low = lambda s: (s["toc"] >= 2) | (s["toc"] + s["numbers"] >= F.greatest(F.lit(3), F.floor(s["lines"] / 2)))
    # A number alone on a line has but blanks between a line's end and itself.
    ends = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
    alone = rf"(?:^|[{ends}])[{_BLANKS}&&[^{ends}]]*+\d{{1,3}}(?:{WS}|$)"
    kinds = c.contains("....") | c.rlike(alone)
    return F.when(F.length(c) < 120, True).when(~kinds, False).otherwise(F.aggregate(F.split(c, LINE_END), start, step, low))


def signature(c: Column, most: int = 800) -> Column:
    """The beginning of a text in lower case with single spaces. Where its first 2 * most characters yield enough, no more are looked at."""
    begin = squeeze(F.lower(strip(F.substring(c, 1, 2 * most))))
    whole = squeeze(F.lower(strip(c)))
    return F.substring(F.when((F.length(c) <= 2 * most) | (F.length(begin) >= most + 64), begin).otherwise(whole), 1, most)


def rag_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-zа-яё0-9]+)"), 1), lambda t: F.length(t) > 1)


def ascii_only(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def digits_only(c: Column) -> Column:
    """Nothing but 0-9, and something."""
    return (F.translate(c, "0123456789", "") == "") & (c != "")


def stem(c: Column) -> Column:
    """From six characters on, drop the longest listed Russian suffix, then the longest English one; four characters stay.

    Suffixes are tried from the longest to the shortest, as ends of the word; Russian ones only on words that are not of ASCII.
    """
    low = F.translate(F.lower(c), "ё", "е")

    def without(w: Column, suffixes: list[str]) -> Column:
        out = None
        for x in sorted(suffixes, key=len, reverse=True):
            hit, cut = w.endswith(x) & (F.length(w) >= len(x) + 4), F.substring(w, F.lit(1), F.length(w) - len(x))
            out = F.when(hit, cut) if out is None else out.when(hit, cut)
        return out.otherwise(w)

    short = F.when(ascii_only(low), low).otherwise(without(low, RU_SUFFIXES))
    return F.when(F.length(low) >= 6, without(short, EN_SUFFIXES)).otherwise(low)


#: Words of lower-cased text without ё from six characters on: what stem leaves of them, and their suffixes. The shortest beginning that leaves a suffix is what is left when the longest suffixes are dropped one after the other, as a Latin suffix cannot stand inside a Russian one.
_STEMMED = "(?=[a-zа-я0-9]{6})([a-zа-я0-9]{4,}?)(?:(?=[iels])(?:" + "|".join(EN_SUFFIXES) + "))?(?:(?=[а-я])(?:" + "|".join(RU_SUFFIXES) + "))?(?![a-zа-я0-9])"

#: All but a letter or digit of a word: as ranges, for a class of what is not in several ranges takes Java four times as long.
_BETWEEN = r"[\x00-/:-`{-\u042f\u0450-\x{10ffff}]"


def stemmed(c: Column) -> Column:
    """A text in lower case with the stem of each word in its place: one pass over the text."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), _STEMMED, "$1")


def concept_tokens(c: Column, stopwords: list[str] = STOPWORDS, generic: list[str] = GENERIC_WORDS) -> Column:
    """Stems of words, without digits, words under three characters, stop words and generic words; stop lists are a parameter."""
    stop = sorted({*stopwords, *generic})
    # Only what is below a colon can begin with a digit.
    return F.filter(F.split(stemmed(c), f"{_BETWEEN}+"), lambda w: (F.length(w) >= 3) & ~w.isin(stop) & ~((w < ":") & digits_only(w)))


def shorten(c: Column, most: int = 180) -> Column:
    c = squeeze(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("...")))


def short_text(c: Column, most: int) -> Column:
    """Squeezed, cut to `most` characters, then back to the last space if there is one."""
    c = squeeze(c)
    cut = F.substring(c, 1, most)
    back = F.rtrim(F.regexp_extract(cut, "^(.*) [^ ]*$", 1))
    return F.when(F.length(c) <= most, c).when(back == "", cut).otherwise(back)


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[А-Яа-яЁё]")


def clean_token(c: Column) -> Column:
    """Three characters and more, of one script, without odd letters; short ones have a vowel. A word of ASCII has neither the other script nor an odd letter."""
    latin, cyrillic = c.rlike("(?i)[a-z]"), c.rlike("(?iu)[а-яё]")
    odd = c.rlike("(?iu)[ьъэ]{2,}") | c.rlike("(?iu)[a-z]{1,2}[ьъэ]|[ьъэ][a-z]{1,2}")
    mixed = F.when(ascii_only(c), False).otherwise((latin & cyrillic) | odd)
    return (F.length(c) >= 3) & ~mixed & ~((F.length(c) <= 4) & ~c.rlike("(?iu)[aeiouyаеёиоуыэюя]"))


def clean_ocr_noise(c: Column) -> Column:
    """Blanks as one space, no lines of contents, no short words around odd letters; the latter two are looked for where there are four points, or such a letter."""
    c = F.regexp_replace(c, r"(?U)[^\S\r\n]+", " ")
    c = F.when(c.contains("...."), F.regexp_replace(c, r"(?m)^.*\.{4,}\s*\d+\s*$", "")).otherwise(c)
    return F.when(c.rlike("[эьъЭЬЪ]"), F.regexp_replace(c, r"(?iuU)\b[а-яёa-z]{1,3}[эьъ][а-яёa-z]{0,3}\b", " ")).otherwise(c)


def fact_tokens(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(clean_ocr_noise(c)), F.lit("([a-zа-яё0-9]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(FACT_STOPWORDS) & clean_token(w))


def clean_source(c: Column) -> Column:
    """Joined line ends and spaces at the borders of sentences, cases and scripts; no number at the end."""
    c = F.translate(F.regexp_replace(c, f"[-‐‑]{WS}*\n{WS}*", ""), "\n", " ")
    c = squeeze(c)
    for old in ("([.!?])([А-ЯA-Z])", "([a-zа-я])([A-ZА-Я])", "([A-Za-z])([А-Яа-я])", "([А-Яа-я])([A-Za-z])"):
        c = F.regexp_replace(c, old, "$1 $2")
    return F.regexp_replace(c, r"(?U)\b\d+\s*$", "")


def prepared_source(c: Column, least: int = 25, sentences_: int = 18, most: int = 3500) -> Column:
    clean = clean_source(c)
    parts = F.filter(nonblank(F.split(clean, f"(?<=[.!?]){WS}+")), lambda s: (F.length(s) >= least) & ~s.rlike(r"(?U)^[\W\d_]+$"))
    return F.substring(F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, sentences_), " ")).otherwise(clean), 1, most)


def tts_text(c: Column, most: int = 280) -> Column:
    return F.substring(squeeze(F.regexp_replace(c, r"""(?U)[^\w\s.,!?;:()"'«»—-]""", " ")), 1, most)


def safe_filename(c: Column, default: str = "presentation") -> Column:
    out = F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(out == "", F.lit(default)).otherwise(out)


def _synonym(c: Column, table: dict[str, str], what: str) -> Column:
    key = F.lower(strip(c))
    out = F.lit(None).cast("string")
    for value, words in table.items():
        out = F.when(key.isin(words.split()), F.lit(value)).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit(f"unknown {what}: "), c)).cast("string"))


def normalize_tone(c: Column) -> Column:
    return _synonym(c, TONES, "tone")


def normalize_pace(c: Column) -> Column:
    return _synonym(c, PACES, "pace")


def normalize_url(c: Column) -> Column:
    c = strip(c)
    full = F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit("https://"), c))
    return F.when(c == "", F.raise_error(F.lit("empty url")).cast("string")).otherwise(F.regexp_replace(full, "#.*$", ""))


def to_float(c: Column, fallback: float = 0.0) -> Column:
    """Comma as point, a percent sign divides by 100; what is no number is the fallback."""
    c = strip(c)
    number = F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), "%$", "").try_cast("double")
    return F.coalesce(F.when(c.endswith("%"), number / 100).otherwise(number), F.lit(float(fallback)))


def model_prefix(c: Column, model: str, is_query: bool = False) -> Column:
    return F.concat(F.lit("query: " if is_query else "passage: "), c) if "e5" in model.lower() else c


def parse_models(c: Column) -> Column:
    return nonblank(F.split(c, "[,;]"))
