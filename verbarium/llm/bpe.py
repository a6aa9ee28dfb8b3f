"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if no merge would cross the border of any two neighbours,
so encoding is a regular relation, and each prefix of a piece has one encoding. The nondeterministic transducer has
configurations (last token, node in the trie of tokens); a determinised state is the set of live configurations, and its
transition on a byte names the one token that can end there. States and transitions are made when a text first needs
them. Which of the ended tokens are on the way to the end is certain as soon as the ways back from all live
configurations meet, a lookahead that the longest token bounds: long pieces emit their certain tokens every FLUSH
bytes, short ones at their end. Work is linear in the bytes, however long a piece is. Pieces repeat, so their outputs
are kept in a bounded table; each comes from the transducer.

Decoding joins the tokens' bytes and feeds them through an incremental UTF-8 state machine that holds back an
incomplete character until its last byte arrives, so a stream can be cut between any two tokens.

Edge cases: null counts as empty; the empty text has no tokens and both digests are that of the empty string; very
long texts and pieces are streamed; repeated rows give repeated results; an empty table gives an empty result; extra
columns are not read. As in the library that the ranks come from, a piece that is itself a token is that token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from verbarium.llm.common import kept, small_batches, table, tidy

#: Entries that a worker keeps for a stage: pieces with their tokens, states of the transducer, border tests (about 120 MB).
PIECES, STATES, BORDERS = 300_000, 100_000, 250_000
#: Bytes after which a long piece's certain tokens leave the transducer.
FLUSH = 4096


class Vocabulary:
    """Ranks of byte strings, and what BPE makes of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.longest = max(self.size.values())
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._borders: dict[tuple[int, int], bool] = {}
        self._edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, data: bytes, below: int) -> list[int]:
        """Plain BPE of a short byte string, by merges of rank under below."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token; (token, token) for a byte; None if no merges make it."""
        if token not in self._halves:
            data = self.bytes[token]
            parts = [token, token] if len(data) == 1 else self.merge(data, token)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def border(self, left: int, right: int) -> bool:
        """Whether BPE of both tokens' bytes keeps the border between them.

        Merges are undone from the youngest on; at each moment the tokens beside the border must not be a pair that
        merges before the next younger merge beside it was done.
        """
        key = (left, right)
        if (known := self._borders.get(key)) is not None:
            return known
        if len(self._borders) > BORDERS:
            self._borders.clear()
        # the ranks at which the right edge of left and the left edge of right grow, youngest first
        edges_l, edges_r = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        until = float("inf")  # a pair merges if its rank is under the next event undone
        kept = True
        while True:
            pair = self.ranks.get(self.bytes[edges_l[i]] + self.bytes[edges_r[j]])
            if pair is not None and pair < until:
                kept = False
                break
            more_l, more_r = i + 1 < len(edges_l), j + 1 < len(edges_r)
            if not more_l and not more_r:
                break
            # equal ranks: the left one is merged first, so the right one is undone first
            if more_l and (not more_r or edges_l[i] > edges_r[j]):
                until = edges_l[i]
                i += 1
            else:
                until = edges_r[j] + 1  # a crossing pair of this very rank would stand further left and win
                j += 1
        self._borders[key] = kept
        return kept

    def _edge(self, token: int, side: int) -> list[int]:
        """token, its half on that side, that half's half ... to a byte: at most two lists for each token."""
        if (out := self._edges[side].get(token)) is None:
            out = [token]
            while self.size[out[-1]] > 1:
                out.append(self.halves(out[-1])[side])
            self._edges[side][token] = out
        return out


class Transducer:
    """The lazily determinised transducer of one vocabulary.

    A configuration (last token, trie node) says: the bytes so far end in that token, but for those that lead to the
    node. A state is the set of live configurations, the longest unfinished one first; the last one is at the root.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        token = [-1]
        for data, i in vocabulary.ranks.items():
            node = 0
            for b in data:
                key = node << 8 | b
                if (nxt := self.child.get(key)) is None:
                    nxt = self.child[key] = len(token)
                    token.append(-1)
                node = nxt
            token[node] = i
        self.token = token
        self.inner = bytearray(len(token))
        for key in self.child:
            self.inner[key >> 8] = 1
        self._reset()

    def _reset(self) -> None:
        self.places: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: state << 8 | byte -> (next state, token that ends here)
        self.steps: dict[int, tuple[int, int]] = {}
        self._place((-1, 0))

    def _place(self, state: tuple) -> int:
        if (at := self.places.get(state)) is None:
            at = self.places[state] = len(self.states)
            self.states.append(state)
        return at

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from state by byte, made now: the next state and the one token that can end here."""
        child, token, inner, border = self.child, self.token, self.inner, self.v.border
        live: list[int] = []
        ended = -1
        flat = self.states[state]
        for i in range(0, len(flat), 2):
            last = flat[i]
            nxt = child.get(flat[i + 1] << 8 | byte)
            if nxt is not None:
                t = token[nxt]
                if t >= 0 and ended < 0 and self.v.halves(t) is not None and (last < 0 or border(last, t)):
                    ended = t
                if inner[nxt]:
                    live += (last, nxt)
        if ended < 0:
            raise ValueError("a prefix without encoding: the ranks lack a byte")
        live += (ended, 0)
        made = self.steps[state << 8 | byte] = (self._place(tuple(live)), ended)
        return made

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a piece. What every live configuration agrees on leaves at once every FLUSH bytes."""
        if (whole := self.v.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > STATES:
            self._reset()
        ends: list[int] = []  # the token that ends after each byte
        out: list[int] = []
        base, state, steps = 0, 0, self.steps
        for byte in piece:
            known = steps.get(state << 8 | byte)
            if known is None:
                known = self._step(state, byte)
            state, token = known
            ends.append(token)
            if len(ends) >= FLUSH:
                base = self._flush(ends, base, out)
        out += self._back(ends, len(ends), 0)
        return out

    def _back(self, ends: list[int], at: int, stop: int) -> list[int]:
        """The tokens that lead to the place at, by the tokens that end there."""
        size, out = self.v.size, []
        while at > stop:
            out.append(ends[at - 1])
            at -= size[ends[at - 1]]
        out.reverse()
        return out

    def _flush(self, ends: list[int], base: int, out: list[int]) -> int:
        """Moves out the tokens before the lookahead that all ways from here share."""
        size, longest = self.v.size, self.v.longest
        ways = set(range(len(ends) - longest, len(ends) + 1))
        while len(ways) > 1:  # the ways back from every place that a live configuration may start at meet in one
            top = max(ways)
            ways.remove(top)
            ways.add(max(0, top - size[ends[top - 1]]))
        (sure,) = ways
        out += self._back(ends, sure, 0)
        del ends[:sure]
        return base + sure


class Utf8Stream:
    """An incremental UTF-8 decoder: feed() returns the text of all characters complete so far."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # the last character's first byte
                need = 1 if byte < 0x80 else 2 if byte >> 5 == 6 else 3 if byte >> 4 == 14 else 4 if byte >> 3 == 30 else 1
                if need > back:
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        """What an unfinished character stands for at the end of the stream."""
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Encoder:
    """Texts to token ids and back, for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        self.v = Vocabulary.load(path)
        self.fst = Transducer(self.v)
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        found, pieces = self.split(text), self.pieces
        if len(pieces) > PIECES:
            pieces.clear()
        for p in set(found).difference(pieces):
            pieces[p] = tuple(self.fst.encode(p.encode()))
        return list(chain.from_iterable(map(pieces.__getitem__, found)))

    def decode_stream(self, ids: list[int], step: int = 8192) -> Iterator[str]:
        stream, known = Utf8Stream(), self.v.bytes
        for i in range(0, len(ids), step):
            yield stream.feed(b"".join(map(known.__getitem__, ids[i : i + step])))
        yield stream.end()


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One per process and vocabulary. Tasks make their own, which goes with their stage."""
    return Encoder(path, pattern)


def _digests(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = kept((path, pattern), lambda: Encoder(path, pattern))
        names = {i: str(i) for i in e.v.bytes}
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = e.encode(text or "")
                decoded = hashlib.sha256()
                for part in e.decode_stream(ids):
                    decoded.update(part.encode())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids array<int>."""
    small_batches(docs.sparkSession)

    def run(batches):
        e = kept((path, pattern), lambda: Encoder(path, pattern))
        for batch in batches:
            ids = [e.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """tokens (doc_id, ids) -> doc_id, text; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        e = kept((path, pattern), lambda: Encoder(path, pattern))
        for batch in batches:
            texts = ["".join(e.decode_stream(ids or [])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(_digests(path, pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_ranks() -> tuple[str, str]:
    """Path and pattern of the rank file that the query encodes by."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    """op4: token counts and digests of all documents."""
    return digests(table(spark, sf_dir, "documents"), *public_ranks())
