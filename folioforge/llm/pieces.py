"""Byte-pair merging over public vocabulary files by a contiguous rank array."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import regex

_NONE = 1 << 60
_LOW = (1 << 24) - 1
#: Words of up to this many parts are scanned; longer ones take a heap, whose work is n log n.
SHORT = 160
#: Characters that the Unicode White_Space property holds.
WHITE = r"\p{White_Space}"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = {b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def merge_scan(parts: list[int], code: dict[int, int]) -> list[int]:
    """Merge in place: ranks[i] is that of the boundary between parts i and i + 1.

    The least rank (the leftmost, if equal) loses its boundary; only the two neighbouring ranks are looked up anew.
    """
    get = code.get
    ranks = [get(a << 24 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while ranks:
        least = min(ranks)
        if least == _NONE:
            break
        i = ranks.index(least)
        parts[i] = least & _LOW
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] << 24 | parts[i], _NONE)
        if i < len(ranks):
            ranks[i] = get(parts[i] << 24 | parts[i + 1], _NONE)
    return parts


def merge_heap(parts: list[int], code: dict[int, int]) -> list[int]:
    """The same result for long words: a heap of (rank, place) over linked parts."""
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(c, i, parts[i], parts[i + 1]) for i in range(n - 1) if (c := code.get(parts[i] << 24 | parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        c, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] == a else n
        if j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = c & _LOW, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if right < n and (d := code.get(parts[left] << 24 | parts[right])) is not None:
                heapq.heappush(heap, (d, left, parts[left], parts[right]))
    return [p for p in parts if p >= 0]


def merge(parts: list[int], code: dict[int, int]) -> list[int]:
    return merge_scan(parts, code) if len(parts) <= SHORT else merge_heap(parts, code)


def odd_blanks(text: str) -> bool:
    """Whether a text holds one of the four characters that Python, but not Unicode's White_Space, takes for white space."""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


class Vocabulary:
    """A byte-level BPE vocabulary of the tokenizers library's JSON form, its merges and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.symbol = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.code: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.code.setdefault(self.ids[a] << 24 | self.ids[b], rank << 24 | self.ids[a + b])
        marks = byte_symbols()
        self.inner = [self.ids.get(m, -1) for m in marks]
        self.last = [self.ids.get(m + self.suffix, -1) for m in marks]
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        raw = piece.encode("utf-8", "replace")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return merge(parts, self.code)


class WordVocabulary(Vocabulary):
    """Words with an end mark: NFC, lower case, white space dropped; words, digits and runs of the rest are pieces."""

    PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
    BLANKS = regex.compile(f"{WHITE}+")

    def __init__(self, path: str, most: int = 250_000):
        super().__init__(path)
        self.pieces: dict[str, tuple[bytes, str]] = {}
        self.most = most
        self.words = _Filled(self._word, most)

    def _piece(self, piece: str) -> tuple[bytes, str]:
        found = self.pieces.get(piece)
        if found is None:
            ids = self.piece_ids(piece)
            found = b"".join(i.to_bytes(4, "little") for i in ids), " ".join([self.symbol[i] for i in ids])
            if len(self.pieces) < self.most and len(piece) <= 64:
                self.pieces[piece] = found
        return found

    def _word(self, word: str) -> tuple[bytes, str]:
        """Little-endian ids and symbols of a run without white space."""
        if "<|" in word and self.split_special is not None:
            parts = [(p, p in self.special) for p in self.split_special.split(word) if p]
        else:
            parts = [(word, False)]
        out = []
        for part, special in parts:
            if special:
                out.append((self.special[part].to_bytes(4, "little"), part))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
                if "Σ" in part:  # lower case goes by single characters: no final sigma
                    part = part.replace("Σ", "σ")
            out += [self._piece(p) for p in self.PIECES.findall(part.lower())]
        return (b"".join([x[0] for x in out]), " ".join([x[1] for x in out])) if len(out) != 1 else out[0]

    def runs(self, text: str) -> list[str]:
        return [w for w in self.BLANKS.split(text) if w] if odd_blanks(text) else text.split()

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a text as little-endian unsigned 32-bit integers, and the decoded text: symbols with spaces between."""
        got = list(map(self.words.__getitem__, self.runs(text)))
        if not got:
            return b"", ""
        ids, said = zip(*got, strict=True)
        return b"".join(ids), " ".join(said)

    def decode(self, ids: list[int]) -> str:
        """Symbols with spaces between, special ones included; ids that the vocabulary lacks are left out."""
        return " ".join([self.symbol[i] for i in ids if i in self.symbol])


class ByteVocabulary(Vocabulary):
    """Byte-level pre-tokens that keep white space; special strings in a text are one token each."""

    PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|{WHITE}+(?!\P{{White_Space}})|{WHITE}+")

    #: A run of non-blanks with a space before it holds whole pre-tokens, so its split can be kept.
    RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+")

    def __init__(self, path: str, most: int = 250_000):
        super().__init__(path)
        self.split = _Filled(lambda run: tuple(self.PIECES.findall(run)), most)

    def pretokens(self, text: str) -> list[str]:
        if "<|" not in text or self.split_special is None:
            if odd_blanks(text):
                return self.PIECES.findall(text)
            return list(chain.from_iterable(map(self.split.__getitem__, self.RUNS.findall(text))))
        out: list[str] = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.PIECES.findall(part)
        return out

    def size(self, pretoken: str) -> int:
        return 1 if pretoken in self.special else len(self.piece_ids(pretoken))

    def pretoken_ids(self, pretoken: str) -> list[int]:
        return [self.special[pretoken]] if pretoken in self.special else self.piece_ids(pretoken)


class _Filled(dict):
    """A dictionary that computes what it lacks and keeps it until it is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most and len(key) <= 64:
            self[key] = value
        return value


@lru_cache(maxsize=4)
def word_vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)


@lru_cache(maxsize=4)
def byte_vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)
