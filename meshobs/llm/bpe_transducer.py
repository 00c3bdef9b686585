"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes if and only if every two neighbours are: no merge
across their border comes before the merges that build them.  Hence the last token of each prefix is unique, and
the encoding can be read off from left to right.  A state of the transducer is the last token that is certain and
the bytes after it.  Reading a byte leads to a next state; when more than ``LOOKAHEAD`` bytes are pending, all tokens
up to the last border that every continuation shares come out.  What stays pending is bounded by the lookahead
and the longest token.  States are made when first needed and kept up to a bound; those beyond it are used once.

Decoding runs ids through a UTF-8 state machine that releases whole characters and holds back unfinished ones.

Nulls: a null text is empty: no tokens, and the digests of the empty string.  Rows are coded one by one, so
repeated rows and clashing columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import cache, lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe_ids import read_ranks

#: Bounds of a worker's memory: states of the transducer and encoded pattern matches.
MAX_STATES, MAX_MATCHES = 60_000, 300_000
#: Pending bytes beyond which the transducer looks for tokens that are certain.
LOOKAHEAD = 16


class State:
    """``prev`` is the last certain token (empty at the start), ``pending`` the bytes after it.

    ``last[i - 1]`` is the last token of the prefix that ends after ``i`` pending bytes; None if no longer needed.
    """

    __slots__ = ("prev", "pending", "last", "next")

    def __init__(self, prev: bytes, pending: bytes, last: tuple[bytes | None, ...]):
        self.prev, self.pending, self.last = prev, pending, last
        self.next: dict[int, tuple[State, tuple[int, ...]]] = {}


class Transducer:
    """Encodes byte strings by ``ranks``."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, lookahead: int = LOOKAHEAD):
        self.ranks, self.max_states, self.lookahead = ranks, max_states, lookahead
        self.longest = max(map(len, ranks))
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.parts = cache(self._parts)
        self.adjacent = lru_cache(1 << 17)(self._adjacent)
        self.start = State(b"", b"", ())
        self.states = {(b"", b""): self.start}

    def merge(self, data: bytes, below: int) -> list[bytes]:
        """Plain BPE of a short string with the merges of a rank under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None for a byte, or if merging never makes it."""
        found = self.merge(token, self.ranks[token]) if len(token) > 1 else []
        return (found[0], found[1]) if len(found) == 2 else None

    def _adjacent(self, a: bytes, b: bytes) -> bool:
        """Whether the border of ``a`` and ``b`` outlives all merges.

        Merges are undone from the last to the first.  Times are twice the rank, plus one for a merge
        right of the border: at equal rank the leftmost comes first.
        """
        until = float("inf")
        while True:
            across = self.ranks.get(a + b)
            if across is not None and 2 * across < until:
                return False
            left, right = self.parts(a), self.parts(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and self.ranks[a] > self.ranks[b]:
                until, a = 2 * self.ranks[a], left[1]
            else:
                until, b = 2 * self.ranks[b] + 1, right[0]

    @staticmethod
    def _borders(last: Sequence[bytes | None], end: int) -> list[int]:
        """Token borders from 0 to ``end``."""
        out = [end]
        while out[-1]:
            out.append(out[-1] - len(last[out[-1] - 1]))
        return out[::-1]

    def _ids(self, data: bytes, borders: list[int]) -> tuple[int, ...]:
        return tuple(self.ranks[data[i:j]] for i, j in zip(borders, borders[1:], strict=False))

    def _last(self, data: bytes, size: int, last: Sequence[bytes | None], prev: bytes) -> bytes:
        """The last token of the first ``size`` bytes of ``data``, given those of shorter prefixes."""
        for start in range(max(0, size - self.longest), size):
            token = data[start:size]
            if token in self.ranks:
                before = last[start - 1] if start else prev
                if (before == b"" or before is not None and self.adjacent(before, token)) and (size - start == 1 or self.parts(token)):
                    return token
        raise ValueError("the vocabulary lacks single bytes")

    def _step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        data, last, out = state.pending + bytes((byte,)), state.last, ()
        size, prev = len(data), state.prev
        last = (*last, self._last(data, size, last, prev))
        if size > self.lookahead:
            # Borders from which a token can still start, and what all ways back from them have in common.
            live = [p for p in range(max(0, size - self.longest), size) if (not p or last[p - 1] is not None) and data[p:] in self.prefixes]
            ways = [set(self._borders(last, p)) for p in (*live, size)]
            if sure := max(set.intersection(*ways)):
                used = set().union(*ways)
                out, prev = self._ids(data, self._borders(last, sure)), last[sure - 1]
                last = tuple(t if p in used else None for p, t in enumerate(last[sure:], sure + 1))
                data = data[sure:]
        key = (prev, data)
        found = self.states.get(key)
        if found is None:
            found = State(prev, data, last)
            if len(self.states) < self.max_states:
                self.states[key] = found
                state.next[byte] = found, out
        else:
            state.next[byte] = found, out
        return found, out

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Ids of ``data``; tokens come out as soon as they are known to be certain."""
        if data in self.ranks:
            return (self.ranks[data],)
        state, ids = self.start, []
        for at, byte in enumerate(data):
            found = state.next.get(byte)
            if found is None:
                if len(self.states) >= self.max_states and len(state.pending) + len(data) - at <= self.lookahead:
                    return (*ids, *self._finish(state, data[at:]))
                found = self._step(state, byte)
            state, out = found
            if out:
                ids += out
        return (*ids, *self._ids(state.pending, self._borders(state.last, len(state.pending))))

    def _finish(self, state: State, rest: bytes) -> tuple[int, ...]:
        """The same steps for a rest within the lookahead, through states that are not kept."""
        data, last = state.pending + rest, list(state.last)
        for size in range(len(last) + 1, len(data) + 1):
            last.append(self._last(data, size, last, state.prev))
        return self._ids(data, self._borders(last, len(data)))


#: Lead bytes: how many bytes follow, and the range of the first of these.
_LEADS = (
    {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
    | {b: (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) for b in range(0xE0, 0xF0)}
    | {b: (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) for b in range(0xF0, 0xF5)}
)


def unfinished(data: bytes) -> int:
    """Length of the tail of ``data`` that is the start of a character."""
    for size in range(1, min(3, len(data)) + 1):
        follow = _LEADS.get(data[-size])
        if follow:
            rest = data[len(data) - size + 1 :]
            fits = all((follow[1] if not i else 0x80) <= b <= (follow[2] if not i else 0xBF) for i, b in enumerate(rest))
            return size if size <= follow[0] and fits else 0
        if not 0x80 <= data[-size] <= 0xBF:
            return 0
    return 0


class _Steps(dict):
    """From one unfinished character: for each token what is released and what is then unfinished."""

    def __init__(self, held: bytes, tokens: list[bytes]):
        super().__init__()
        self.held, self.tokens = held, tokens

    def __missing__(self, token: int) -> tuple[bytes, bytes]:
        data = self.held + self.tokens[token]
        cut = len(data) - unfinished(data)
        self[token] = data[:cut], data[cut:]
        return self[token]


class Decoder:
    """Streams ids into bytes of whole characters."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.steps = tokens, {}

    def __call__(self, ids: Iterable[int]) -> Iterator[bytes]:
        steps = self.steps.get(b"") or self.steps.setdefault(b"", _Steps(b"", self.tokens))
        free = steps
        held = b""
        for token in ids:
            out, held = steps[token]
            if out:
                yield out
            steps = free if not held else self.steps.get(held) or self.steps.setdefault(held, _Steps(held, self.tokens))
        if held:
            yield held


class Codec:
    """A worker's encoder and decoder of whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.decode = Decoder(tokens)
        self.names = [str(i).encode() for i in range(len(tokens))]
        #: Encoded matches: those met since the last turn, and those of the turn before.
        self.matches: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        if len(self.matches) > MAX_MATCHES:
            self.older, self.matches = self.matches, {}
        known, older, ids = self.matches, self.older, []
        for match in self.pattern.findall(text):
            found = known.get(match)
            if found is None:
                found = known[match] = older.get(match) or self.transducer.encode(match.encode())
            ids += found
        return ids


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; ``doc_id`` keeps its type."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in pc.fill_null(batch.column("text"), ""):
                ids = coder.encode(text.as_py())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(coder.names.__getitem__, ids))).hexdigest())
                decoded_sha.append(hashlib.sha256(b"".join(coder.decode(ids))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(code, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and the ids of each text as ``array<int>``."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in batches:
            ids = [coder.encode(t) for t in pc.fill_null(batch.column("text"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(code, f"doc_id {kind}, ids array<int>")
