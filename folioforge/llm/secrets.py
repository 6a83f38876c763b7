"""Operator 7: secret scans by patterns and by assignment-aware lexing."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame

from .common import arrow_map, text_or_empty

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Runs of at least the length that counts: the same leftmost matches as the runs of any length, the short ones dropped.
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How strongly a part of a name says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "bearer": 0.8}
#: Parts of a name that say it is about a secret, without being one.
HARMLESS = {"count", "counts", "counter", "length", "len", "limit", "max", "min", "size", "type", "name", "file", "path", "url", "uri", "hint", "policy", "field", "label", "index", "id", "per", "enabled", "required", "expiry", "ttl", "user", "username", "login", "email", "host", "hostname", "port", "region", "role", "scope", "issuer"}
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|<[^>]*>|\$?\{\{?[^}]*\}\}?|%\w*%|your[-_ ].*|change[-_ ]?me|example.*|placeholder.*|redacted|secret|password|passwd|token|none|null|nil|true|false|undefined|todo)$")
LEAST = 0.6
#: Calls whose first argument is the name of a setting, not its value; attributes and keys that name what another one gives.
KEYED = {"getenv", "get", "env", "environ", "getproperty", "getstring", "lookup", "config", "setting"}
NAMING, GIVING = {"key", "name", "id", "property"}, {"value", "content", "default"}

#: What every sensitive name has in it once all but letters and digits is taken out: only texts with one are lexed.
LIKELY = re.compile("password|passwd|passphrase|pwd|secret|token|credential|bearer|(?:api|private|access|secret|auth|signing|encryption)key")
NOT_IN_WORDS = re.compile("[^A-Za-z0-9]+")
#: Whole strings from their first quote. What a run has read is not given back, so a match is linear.
STRINGS = {
    **{q * 3: re.compile(rf"{q * 3}(?:[^{q}\\]|\\[\s\S]|{q}(?!{q * 2}))*+{q * 3}") for q in "\"'"},
    **{q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*+{q}") for q in "\"'"},
    "`": re.compile("`[^`\n]*+`"),
}
TOKEN = re.compile(r"""
      (?P<quote>\"""|'''|["`]|(?:(?<!\w)|(?<=\b[bBrRuUfFLNnEeXx])|(?<=\b[bBrRfF]{2}))')
    | (?P<name>[A-Za-z_$][\w$]*+(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*+)*+)
    | (?P<op>:=|=>|==|!=|<=|>=|\+=|=|:)
    | (?P<plus>\+(?=["'`\s]))
    | (?P<bare>[A-Za-z0-9+/_.\-]++)
    | (?P<end>[;\n,{}()\[\]])
""", re.VERBOSE)


ASSIGNS = (":=", "=", ":", "=>", "+=")
#: A value without quotes, as configuration files have it.
BARE = re.compile(r"""[^\s"'`,;(){}\[\]]++""")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end in code points: leftmost non-overlapping matches of each kind; those that are too short are dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGNED):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    """0 to 1: how sensitive a target name is, by its last parts (snake, kebab, dotted or camel case)."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    joined = [*parts, *("".join(parts[i : i + 2]) for i in range(len(parts) - 1))]
    found = [SENSITIVE[p] for p in joined if p in SENSITIVE]
    return max(found, default=0.0)


class Value:
    """A literal, or several joined: its characters by number, and where its literals are. Joining costs no more than the kinds of characters."""

    __slots__ = ("span", "parts", "size", "counts", "head")

    def __init__(self, text: str = "", start: int = 0, parts: list[Value] | None = None):
        self.parts, self.span = parts, (start, start + len(text))
        self.size, self.counts, self.head = len(text), Counter(text), text[:65]
        for p in parts or ():
            self.size += p.size
            self.counts.update(p.counts)
            self.head = (self.head + p.head)[:65]

    def score(self) -> float:
        """0 to 1: how much it looks like a secret: long, without blanks, of many kinds of characters."""
        if self.size < 6 or any(c.isspace() for c in self.counts) or (self.size < 65 and PLACEHOLDERS.match(self.head)):
            return 0.0
        entropy = -sum(n / self.size * math.log2(n / self.size) for n in self.counts.values())
        kind = lambda c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3
        return min(1.0, entropy / 4 * 0.6 + len(set(map(kind, self.counts))) / 3 * 0.3 + min(self.size, 20) / 20 * 0.1)


def literal_score(value: str) -> float:
    return Value(value).score()


def joined_value(parts: list[Value]) -> Value:
    return parts[0] if len(parts) == 1 else Value(parts=list(parts))


#: A name, how sensitive it is (or what it stands in), and a value that reaches it.
Pair = tuple[str, float, Value]


def inherited(name: str, above: float) -> float:
    """A name's score, or that of what it stands in, unless it says something harmless."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    return 0.0 if parts and parts[-1].lower() in HARMLESS else max(above, name_score(name))


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs of source and configuration syntax.

    name = expression, name := ..., name += ..., "name": ..., name => ... and key: bare-value are read, one statement a line or up
    to ; , and brackets. An expression is string literals and names, joined with + or standing side by side; a name stands for what
    it was last given (constants), so a secret is found where it is written though another name receives it, and in all its
    parts. The arguments of a call and the items of a list are values each; the first argument of calls that look a setting up, and an
    index in brackets, are not. Names inside { } of a sensitive name are as sensitive, unless they are harmless.
    """
    constants: dict[str, Value] = {}
    out: list[Pair] = []
    targets: list[tuple[str, bool]] = []
    terms: list[list[Value]] = [[]]
    keyed: list[bool] = []  # for each bracket that is open in an expression: whether what comes next is a key
    scopes: list[float] = [0.0]
    last, last_kind, last_end, joined, fresh, pos = "", "", -1, False, False, 0
    naming = ""

    def close() -> None:
        nonlocal naming
        filled = [joined_value(t) for t in terms if t]
        for name, adds in targets if filled else ():
            first = joined_value([constants[name], filled[0]]) if adds and name in constants else filled[0]
            constants[name] = first
            s = inherited(name, scopes[-1])
            out.extend((name, s, v) for v in (first, *filled[1:]))
            low = name.lower()
            if low in GIVING and naming:
                out.append((naming, name_score(naming), first))
            naming = first.head if low in NAMING and first.parts is None else ""
        targets.clear()
        keyed.clear()
        terms[:] = [[]]

    dead: dict[str, int] = {}  # quote -> up to where it opens no string

    def string_at(quote: str, start: int) -> int:
        """Where the string that begins here ends, or 0. After an open one, the same quote opens none as far as that was read."""
        for q in (quote, quote[0]):
            if start >= dead.get(q, 0):
                if found := STRINGS[q].match(text, start):
                    return found.end()
                line = text.find("\n", start) if len(q) == 1 else -1
                dead[q] = len(text) if line < 0 else line
        return 0

    while m := TOKEN.search(text, pos):
        kind, word, start, pos = m.lastgroup, m[0], m.start(), m.end()
        if kind == "quote":
            if not (end := string_at(word, start)):
                pos = start + 1
                continue
            kind, wide, pos = "string", 3 if end - start >= 6 and len(word) == 3 and text.endswith(word, start, end) else 1, end
        if kind == "op":
            if word in ASSIGNS and last:
                if keyed:
                    close()
                if targets and terms[-1] and terms[-1][-1].span[1] >= last_end - 1:
                    terms[-1].pop()  # name: type = literal, or a = b = literal
                elif targets and terms[-1]:
                    close()
                targets.append((last, word == "+="))
                fresh = True
            last, last_kind, joined = "", "", False
            continue
        if kind == "end":
            if word in "([" and targets and (fresh or keyed or (last_kind == "name" and start == last_end)):
                called = last_kind == "name" and not fresh
                keyed.append(called and (word == "[" or re.split(r"\W|_", last.lower())[-1] in KEYED))
                joined = bool(joined)
            elif word in ")]" and keyed:
                keyed.pop()
            elif word == "," and keyed:
                terms.append([])
                keyed[-1] = joined = False
            elif word in "[]":
                last_end = pos
                continue
            elif word == "\n" and keyed:
                continue
            else:
                if word == "{":
                    scopes.append(inherited(targets[-1][0], scopes[-1]) if targets and not any(terms) else scopes[-1] if len(scopes) > 1 else 0.0)
                    targets.clear() if not any(terms) else None
                close()
                if word in "{};":
                    naming = ""
                if word == "}" and len(scopes) > 1:
                    scopes.pop()
            last, last_kind, fresh = "", "", fresh and word in "(["
            continue
        if kind == "plus":
            joined = bool(terms[-1])
        else:
            if kind == "string":
                inner, at = text[start + wide : pos - wide], start + wide
                if wide == 3:  # blanks around the value are not its own
                    at += len(inner) - len(inner.lstrip())
                    inner = inner.strip()
            else:
                inner, at = word, start
            beside = kind == last_kind == "string"
            if targets and not (keyed and keyed[-1]) and (joined or not terms[-1] or beside):
                if kind == "string":
                    terms[-1].append(Value(inner, at))
                elif word in constants:
                    terms[-1].append(constants[word])
                elif fresh and (bare := BARE.match(text, start)):
                    if any(c.isdigit() for c in bare[0]):  # a call or another name is not a literal
                        pos = bare.end()
                        inner = bare[0]
                        terms[-1].append(Value(inner, start))
            last, last_kind, last_end, joined = inner, kind, pos, False
        fresh = False
    close()
    return out


#: A tag with its attributes, and the text up to the next one.
TAG = re.compile(r"""<([A-Za-z][\w:.-]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+)>([^<]*+)""")
ATTRIBUTE = re.compile(r"""([A-Za-z][\w:.-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""")


def markup_pairs(text: str) -> list[Pair]:
    """Pairs of markup: the text of a sensitive element, and the value or text of one that is named so by an attribute (see NAMING, GIVING)."""
    out = []
    for m in TAG.finditer(text):
        held = {a[1].lower(): (a[2] if a[2] is not None else a[3], m.start(2) + a.start(2 if a[2] is not None else 3)) for a in ATTRIBUTE.finditer(m[2])}
        name = next((held[k][0] for k in held if k in NAMING), m[1])
        given = [held[k] for k in held if k in GIVING]
        inner = m[3].strip()
        given += [(inner, m.start(3) + m[3].index(inner))] if inner else []
        out += [(name, name_score(name), Value(v, at)) for v, at in given]
    return out


LINE = re.compile(r"""([ \t]*+)((?:-[ \t]++)*+)(?:(["']?)([A-Za-z_][\w.\-/ ]*?)\3[ \t]*+:(?=[ \t]|$)[ \t]*+)?(.*)""")
BLOCK = re.compile(r"[|>][-+0-9]*+[ \t]*+$")


def indented_pairs(text: str) -> list[Pair]:
    """Pairs of indented configuration: scalars under a key on the next lines, block scalars (their lines joined), list items, keys under a
    sensitive key, and name and value side by side. A scalar is quoted or has a digit, as with key: value on one line.
    """
    out: list[Pair] = []
    above: list[tuple[int, str, float]] = []
    named: dict[int, str] = {}
    block: tuple[int, str, float, list[Value]] | None = None
    at = 0

    def scalar(raw: str, start: int) -> Value | None:
        raw = raw.strip()
        if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'":
            return Value(raw[1:-1], start + 1)
        return Value(raw, start) if any(c.isdigit() for c in raw) and not raw.startswith(("{", "[", "#")) else None

    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        if not line.strip():
            continue
        m = LINE.match(line)
        indent = len(m[1]) + len(m[2])
        if block:
            if len(m[1]) > block[0]:
                block[3].append(Value(line.strip(), begin + len(m[1])))
                continue
            out.append((block[1], block[2], joined_value(block[3]))) if block[3] else None
            block = None
        rest, start = m[5], begin + m.start(5)
        while above and above[-1][0] >= (indent if m[4] else indent if m[2] else len(m[1])):
            above.pop()
        for k in [k for k in named if k > indent] if named else ():
            del named[k]
        s = above[-1][2] if above else 0.0
        if m[4] is None:
            if above and s and (v := scalar(rest, start)):
                out.append((above[-1][1], s, v))
            continue
        if m[2]:
            named.pop(indent, None)
        key, own = m[4], inherited(m[4], s)
        if BLOCK.match(rest):
            block = (len(m[1]) + len(m[2]) if not m[2] else len(m[1]), key, own, [])
        elif not rest.strip():
            above.append((indent, key, own))
        elif v := scalar(rest, start):
            low = key.lower()
            if low in GIVING and indent in named:
                out.append((named[indent], name_score(named[indent]), v))
            elif s:
                out.append((key, own, v))
            if low in NAMING:
                named[indent] = rest.strip().strip("\"'")
        elif key.lower() in NAMING:
            named[indent] = rest.strip()
    if block and block[3]:
        out.append((block[1], block[2], joined_value(block[3])))
    return out


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of literals that reach a sensitive name and, alone or joined, look like secrets: with a joined one, all its literals."""
    if not ("=" in text or ":" in text or "</" in text) or not LIKELY.search(NOT_IN_WORDS.sub("", text).lower()):
        return []
    found: set[tuple[str, int, int]] = set()
    marked: set[int] = set()
    held = pairs(text) + (markup_pairs(text) if "<" in text else []) + (indented_pairs(text) if "\n" in text and ":" in text else [])
    for _, s, value in held:
        if s <= 0:
            continue
        todo = [(value, s * value.score() >= LEAST)]
        while todo:
            v, whole = todo.pop()
            # A value is gone through once for each reason; one that is marked as a whole is done.
            if id(v) in marked or (not whole and -id(v) in marked):
                continue
            marked.add(id(v) if whole else -id(v))
            if v.parts is None:
                if v.span[1] > v.span[0] and (whole or s * v.score() >= LEAST):
                    found.add(("lexed", *v.span))
            else:
                todo += [(p, whole) for p in v.parts]
    return sorted(found, key=lambda x: x[1:])


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then by kind as listed. Lexed spans inside a base span are left to it."""
    base = base_spans(text)
    begins, reach = [], []
    for _, a, b in sorted(base, key=lambda x: x[1]):
        begins.append(a)
        reach.append(max(b, reach[-1] if reach else b))
    inside = lambda a, b: (k := bisect_right(begins, a)) > 0 and reach[k - 1] >= b
    more = [x for x in lexed_spans(text) if not inside(x[1], x[2])]
    return sorted([*base, *more], key=lambda x: (x[1], KINDS.index(x[0])))


def said(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text.

    Base spans are pattern matches; lexing adds the literals of sensitive names (kind lexed) and takes none away: those of
    assignments (see pairs), of markup and of indented configuration, whole, however far names, signs and literals stand apart.
    A null or empty text has no span: zeros, the hash of the empty string and an empty spans. A null doc_id stays
    null; repeated rows give repeated rows; other columns are ignored. One map without a shuffle.
    """

    def rows(it):
        for b in it:
            found = [spans(t) for t in b["text"]]
            base = [[x for x in f if x[0] != "lexed"] for f in found]
            count = lambda k: [sum(x[0] == k for x in f) for f in base]
            yield {"doc_id": b["doc_id"], "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "base_sha256": [hashlib.sha256(said(f).encode()).hexdigest() for f in base], "spans": [said(f) for f in found]}

    return arrow_map(text_or_empty(docs), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", rows)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    for _, a, b in spans(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with its columns as they are, secrets in text replaced by a mark, and n_chars set anew where it is a column.

    Cases: null texts stay null; rows without a secret are unchanged; repeated rows stay as they are, each; a text that
    holds the mark already keeps it; texts of any length are taken whole; an empty table gives no rows.
    """
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def clean(text):
        return text.map(lambda t: t if t is None else redacted(t))

    from .common import batches

    batches(docs.sparkSession)
    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
