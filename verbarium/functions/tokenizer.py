"""The full surface tokenizer: e-mail, URL, hashtag, mention, word with components, abbreviation, number, currency,
emoji, punctuation, with UTF-8 byte offsets, and sentences. For Arrow batches; counts use the pattern in corpus.py."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import regex

#: Abbreviations that keep their full stop, clipped words that keep their apostrophe, closing marks.
ABBREVIATIONS = frozenset("dott dr ecc ing prof sig sigg sigra".split())
CLIPPED = frozenset("be fa mo po sta va".split())
CLOSERS = ".!?\"'’”)]}"
TRAILING = ".,;:!?"

_EMAIL = regex.compile(r"[^@\s]+@[^@\s.][^@\s]*\.[^@\s]*[^@\s.]|[^@\s]+@[^@\s.]+\.[^@\s.]+")
_URL = regex.compile(r"(?i)https?://[^/?#\s]+\S*")
_RUN = regex.compile(r"\S+")
_PARTS = regex.compile(
    r"(?P<hashtag>#[\p{L}\p{M}\p{Nd}][\p{L}\p{M}\p{Nd}_]*)|(?P<mention>@[\p{L}\p{M}\p{Nd}][\p{L}\p{M}\p{Nd}_]*)"
    r"|(?P<word>[\p{L}\p{M}](?:[\p{L}\p{M}\p{Nd}]|['’-][\p{L}\p{M}\p{Nd}])*)|(?P<number>\p{Nd}+(?:[.,]\p{Nd}+)*)|(?P<other>\X)"
)


@dataclass
class Token:
    start: int
    end: int
    surface: str
    kind: str
    components: list[tuple[int, int]] = field(default_factory=list)

    @property
    def lexical(self) -> bool:
        return self.kind not in ("punctuation", "currency")


def _kind(cluster: str) -> str:
    if unicodedata.category(cluster[0]) == "Sc":
        return "currency"
    return "emoji" if regex.match(r"\p{Emoji_Presentation}|\p{Extended_Pictographic}", cluster) else "punctuation"


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    at, byte, stop, trimmed = 0, 0, 0, 0

    def add(n: int, kind: str) -> None:
        nonlocal at, byte
        surface = text[at : at + n]
        size = len(surface.encode())
        parts = []
        if kind == "word" and (m := regex.search("['’]", surface)) and m.end() < len(surface):
            half = byte + len(surface[: m.end()].encode())
            parts = [(byte, half), (half, byte + size)]
        out.append(Token(byte, byte + size, surface, kind, parts))
        at, byte = at + n, byte + size

    while at < len(text):
        if text[at].isspace():
            byte += len(text[at].encode())
            at += 1
            continue
        if at >= stop:
            run = _RUN.match(text, at)[0]
            stop, trimmed = at + len(run), at + len(run.rstrip(TRAILING))
        chunk = text[at:trimmed] if trimmed - at <= 2048 else ""
        if chunk and _URL.fullmatch(chunk):
            add(len(chunk), "url")
        elif chunk and len(chunk) <= 320 and chunk.count("@") == 1 and _EMAIL.fullmatch(chunk):
            add(len(chunk), "email")
        else:
            m = _PARTS.match(text, at)
            kind, word = m.lastgroup, m[0]
            n = len(word)
            if kind == "word" and word.lower() in ABBREVIATIONS and text[at + n : at + n + 1] == ".":
                add(n + 1, "abbreviation")
            elif kind == "word" and word.lower() in CLIPPED and text[at + n : at + n + 1] in ("'", "’"):
                add(n + 1, "word")
            else:
                add(n, _kind(word) if kind == "other" else kind)
    return out


def sentences(text: str, tokens: list[Token] | None = None) -> list[tuple[int, int]]:
    """Byte ranges: a line end between tokens ends a sentence, and so do . ! ? with the closing marks that touch them."""
    tokens = tokenize(text) if tokens is None else tokens
    raw, out, first = text.encode(), [], 0
    i = 0
    while i < len(tokens):
        t = tokens[i]
        closed = t.kind == "punctuation" and t.surface in ".!?"
        while closed and i + 1 < len(tokens) and tokens[i + 1].start == tokens[i].end and tokens[i + 1].surface in CLOSERS:
            i += 1
        last = i + 1 == len(tokens)
        if closed or last or b"\n" in raw[tokens[i].end : tokens[i + 1].start]:
            out.append((tokens[first].start, tokens[i].end))
            first = i + 1
        i += 1
    return out


def normalised(surface: str) -> str:
    return unicodedata.normalize("NFC", surface).lower()
