"""The full tokenizer over slices of many texts: the tokens and sentence ends of `tokenizer`, as numpy columns.

Outside of a few graphemes that take in white space, a token depends only on its run of non-space characters, and of
ASCII letters and digits only their class counts, but in links, abbreviations and clipped words. So runs are looked up
by shape (such runs as they are), each shape goes through `tokenizer.tokenize` once, and its tokens are laid out by numpy.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import regex

from verbarium.functions import tokenizer

KINDS = ("word", "number", "punctuation", "currency", "emoji", "hashtag", "mention", "abbreviation", "email", "url")
#: Bytes of text in a slice (a longer text is a slice of its own), and shapes and their tokens that a worker keeps at most.
SLICE_BYTES, MOST_SHAPES, MOST_TOKENS = 1 << 20, 1 << 18, 1 << 22

_SHAPE = bytes(97 if chr(b).isalpha() and b < 128 else 48 if 48 <= b < 58 else b for b in range(256))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: White space of more than one byte.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: What makes single letters count, in lower case.
_LITERAL = [b"://", *(f"{w}.".encode() for w in sorted(tokenizer.ABBREVIATIONS)), *(f"{w}{q}".encode() for w in sorted(tokenizer.CLIPPED) for q in "'’")]
#: Graphemes that take in a following space; their lead bytes.
_JOINS, _MAY_JOIN = regex.compile(r"\p{GCB=Prepend}\s"), re.compile(rb"[\xd8-\xe0\xf0-\xf4]")


class _Shapes(dict):
    """Run -> id, and by id the run's tokens: relative start, bytes, kind, and whether a sentence ends after it within the run."""

    def __init__(self) -> None:
        self.first, self.start, self.size, self.kind, self.ends, self.as_is = array("q", [0]), array("i"), array("i"), array("b"), array("b"), {}

    def _add(self, run: bytes) -> int:
        self.put(tokenizer.tokenize(run.decode()))
        return len(self.first) - 2

    def put(self, toks: list[tokenizer.Token]) -> None:
        chain, n = False, len(toks)
        for i, t in enumerate(toks):
            touches = i and toks[i - 1].end == t.start
            chain = (t.kind == "punctuation" and t.surface in ".!?") or bool(chain and touches and t.surface in tokenizer.CLOSERS)
            more = i + 1 < n and toks[i + 1].start == t.end and toks[i + 1].surface in tokenizer.CLOSERS
            self.start.append(t.start)
            self.size.append(t.end - t.start)
            self.kind.append(KINDS.index(t.kind))
            self.ends.append(chain and not more)
        self.first.append(len(self.start))

    def __missing__(self, run: bytes) -> int:
        self[run] = k = self._add(run)
        return k

    def exact(self, run: bytes) -> int:
        if run not in self.as_is:
            self.as_is[run] = self._add(run)
        return self.as_is[run]


_kept = _Shapes()


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts in UTF-8); null counts as empty."""
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        if part and size + len(raw) > SLICE_BYTES:
            yield first, part
            part, size, first = [], 0, i
        part.append(raw)
        size += len(raw)
    if part:
        yield first, part


def _slow(raws: list[bytes]) -> dict[str, np.ndarray]:
    """One text after the other, by the tokenizer."""
    rows = []
    for d, raw in enumerate(raws):
        toks = tokenizer.tokenize(text := raw.decode())
        ends, k = [e for _, e in tokenizer.sentences(text, toks)], 0
        for i, t in enumerate(toks):
            while t.start >= ends[k]:
                k += 1
            rows.append((d, i, t.start, t.end, KINDS.index(t.kind), k))
    made = np.array(rows, np.int64).reshape(-1, 6).T
    return dict(zip(("doc", "idx", "start", "end", "kind", "sent"), made, strict=True))


def columns(raws: list[bytes], only_kinds: bool = False) -> dict[str, np.ndarray]:
    """doc (place in raws), idx, start, end, kind (place in KINDS), sent of all tokens; or kind alone."""
    global _kept
    raw = b"\n".join(raws)
    if _MAY_JOIN.search(raw) and any(_MAY_JOIN.search(x) and _JOINS.search(x.decode()) for x in raws):
        return _slow(raws) if len(raws) == 1 else _joined([columns([x], only_kinds) for x in raws], only_kinds)
    if len(_kept.first) > MOST_SHAPES or len(_kept.start) > MOST_TOKENS:
        _kept = _Shapes()
    shapes = _kept
    if not raw.isascii():
        raw = _WIDE.sub(lambda m: b" " * len(m[0]), raw)
    shaped = raw.translate(_SHAPE)
    runs = shaped.split()
    ids = np.fromiter(map(shapes.__getitem__, runs), np.int64, len(runs))
    space = _SPACE[np.frombuffer(b" " + shaped, np.uint8)]
    at = np.flatnonzero(~space[1:] & space[:-1])
    low = raw.lower()
    for literal in _LITERAL:
        found = low.find(literal)
        while found >= 0:
            k = int(np.searchsorted(at, found, "right")) - 1
            end = int(at[k]) + len(runs[k])
            ids[k] = shapes.exact(raw[at[k] : end])
            found = low.find(literal, end)
    first = np.frombuffer(shapes.first, np.int64)
    n = first[ids + 1] - first[ids]
    if not n.all():
        ids, at, n = ids[n > 0], at[n > 0], n[n > 0]
    last = np.cumsum(n)
    place = np.arange(last[-1] if len(n) else 0) + np.repeat(first[ids] - last + n, n)
    kind = np.frombuffer(shapes.kind, np.int8)[place] if len(place) else np.zeros(0, np.int8)
    if only_kinds:
        return {"kind": kind}
    if not len(place):
        return dict.fromkeys(("doc", "idx", "start", "end", "sent"), place) | {"kind": kind}
    begins = np.cumsum([0, *(len(x) + 1 for x in raws)])
    of_run = np.searchsorted(begins, at, "right") - 1
    lines = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), at)
    ends = np.frombuffer(shapes.ends, np.int8)[place] > 0
    ends[last - 1] |= np.concatenate([lines[1:] > lines[:-1], [True]])
    doc = np.repeat(of_run, n)
    start = np.frombuffer(shapes.start, np.int32)[place] + np.repeat(at - begins[of_run], n)
    before = np.cumsum(ends) - ends
    head = np.searchsorted(doc, np.arange(len(raws)))
    whole = np.append(before, 0)
    return {"doc": doc, "idx": np.arange(len(doc)) - head[doc], "start": start, "end": start + np.frombuffer(shapes.size, np.int32)[place], "kind": kind, "sent": before - whole[head][doc]}


def _joined(parts: list[dict], only_kinds: bool) -> dict[str, np.ndarray]:
    if not only_kinds:
        for d, x in enumerate(parts):
            x["doc"] = x["doc"] + d
    return {c: np.concatenate([x[c] for x in parts]) for c in (("kind",) if only_kinds else parts[0])}


#: Bytes of a text that are looked at first for its passage, and how much more each time that they do not hold it.
PREFIX_BYTES, GROWTH = 1 << 11, 8
#: A blank that no grapheme before it takes in.
_BLANK = re.compile(rb"(?<=[\x00-\x7f])[ \t\n]")


def ranges(raws: list[bytes], first: int, last: int) -> list[tuple[int, int] | None]:
    """Byte range of sentences first to last of each text, None where it has none of them.

    A text is read until sentence last has ended: what follows cannot change it.
    """
    out: list = [None] * len(raws)
    todo, size = list(range(len(raws))), PREFIX_BYTES
    while todo:
        cut, whole = [], []
        for i in todo:
            raw = raws[i]
            m = _BLANK.search(raw, size) if len(raw) > size else None
            whole.append(not m)
            cut.append(raw[: m.start()] if m else raw)
        cols = columns(cut)
        doc, sent, start, end = cols["doc"], cols["sent"], cols["start"], cols["end"]
        edge = np.searchsorted(doc, np.arange(len(todo) + 1))
        rest = []
        for k, i in enumerate(todo):
            a, b = edge[k], edge[k + 1]
            if not whole[k] and (a == b or sent[b - 1] <= last):
                rest.append(i)
                continue
            low, high = a + np.searchsorted(sent[a:b], first), a + np.searchsorted(sent[a:b], last, "right")
            out[i] = (int(start[low]), int(end[high - 1])) if low < high else None
        todo, size = rest, size * GROWTH
    return out
