"""Sentence-piece BPE by rounds of merges over flat numpy arrays, and the decoder.

A text becomes one string with ``▁`` for spaces and one in front.  It is cut into words where no piece of the vocabulary
has the two characters side by side, so no merge crosses a cut.  All words of a batch that are not known yet lie in
flat arrays of symbols.  In each round every word looks up the ranks of its neighbouring pairs, finds its least rank with
a segmented minimum, and merges all pairs of that rank from the left, those that overlap one taken before left out.  A word's
later merges wait for the next round if an earlier one makes a pair that comes before them, so the order is that of merging
one at a time.  Words without a mergeable pair leave the arrays; the rest is compacted.  A word of more than ``MAX_ROUND``
symbols (a blob without cuts, a run of spaces) would need as many rounds, so it is merged with a heap in the same order.

Characters outside the vocabulary come out as their UTF-8 bytes' pieces.  Decoding joins the pieces' bytes, drops the space put
in front, and shows each byte that is no UTF-8 as U+FFFD.

Nulls: a null text counts as empty and has the begin and end ids only; null ids decode to an empty text.  Rows are coded one by
one, so repeated rows and clashing columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Symbols of a word up to which rounds are run on it.
MAX_ROUND = 512
#: Bounds of a worker's memory: words kept with their ids, their characters, and words looked at together.
MAX_WORDS, MAX_CHARS, WINDOW = 300_000, 24, 1 << 16
#: No pair, or none that may be merged.
NEVER = np.int32(2**31 - 1)
GONE = -2


def _bytewise(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("piecewise", _bytewise)


def word_pattern(known: list[str]) -> re.Pattern | None:
    """The finest way found to cut a text by classes of neighbouring characters so that no piece lies across a cut.

    Letters are parted from all else, and both from spaces after them; letters that a piece has beside something else count as
    something else.  If that does not do, spaces alone begin words; if a piece has a space after something else, nothing does.
    """
    odd: set[str] = set()
    while True:
        letter, other = (re.compile(f"[{inner}{re.escape(''.join(sorted(odd)))}]") for inner in (r"^\W\d_", r"\W\d_"))
        way = re.compile(f"{SPACE}*{letter.pattern}+|{SPACE}*(?:(?!{SPACE}){other.pattern})+|{SPACE}+")
        found = {c for p in known if len(parts := way.findall(p)) > 1 for a, b in zip(parts, parts[1:], strict=False) for c in (a[-1], b[0]) if letter.match(c)}
        if not found:
            break
        odd |= found
    ways = [way, re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")]
    return next((w for w in ways if all(len(w.findall(p)) == 1 for p in known)), None)


class Pieces:
    """The tables of a model file: single characters, mergeable pairs with their ranks, and pairs of characters that some piece has."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and without normalisation are known")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not known")
        self.begin, self.end = (next(i for i, p in enumerate(model.pieces) if p.piece == x) for x in (model.trainer_spec.bos_piece, model.trainer_spec.eos_piece))
        self.front = SPACE if rules.add_dummy_prefix else ""
        self.size = len(model.pieces)
        known = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        self.shown: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.shown.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.shown.append({kinds.NORMAL: p.piece.replace(SPACE, " "), kinds.UNKNOWN: model.trainer_spec.unk_surface}.get(p.type, "").encode())
        self.spaced = {i for p, i in known.items() if p.startswith(SPACE)} if self.front else set()
        self.chars = np.full(0x110000, -1, np.int32)
        for piece, i in known.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        # Equal scores share a rank: among them the leftmost pair comes first, whatever its piece.
        order = {s: k for k, s in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        pairs = {known[p[:k]] * self.size + known[p[k:]]: i for p, i in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known}
        self.keys = np.array(sorted(pairs), np.int64)
        self.into = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = np.array([order[model.pieces[i].score] for i in self.into.tolist()], np.int32)
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for p in known for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.word = word_pattern(list(known))
        self.words: dict[str, bytes] = {}
        self.long: list[str] = []
        self.control = np.zeros(self.size, bool)
        self.control[[self.begin, self.end]] = True

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; ``NEVER`` where the two do not merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.rank[at], NEVER), np.where(found, self.into[at], -1)

    def cuts(self, text: str) -> Iterator[str]:
        """The text in words, each small enough to be looked up."""
        if not text:
            return iter(())
        whole = self.front + text.replace(" ", SPACE)
        if self.word is None:
            return iter((whole,))
        if len(whole) <= WINDOW:
            return iter(self.word.findall(whole))
        return (m.group() for m in self.word.finditer(whole))

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit numbers."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        out = self.chars[points]
        pair = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        starts = np.ones(len(points), bool)
        starts[1:] = self.beside[at] != pair
        starts[ends[:-1]] = True
        self._merge(out, starts)
        return self._written(out, points, ends)

    def _merge(self, out: np.ndarray, starts: np.ndarray) -> None:
        """Merge the symbols of ``out`` within the segments that begin at ``starts``; what is swallowed becomes ``GONE``."""
        first = np.flatnonzero(starts)
        length = np.diff(first, append=len(out))
        for a, n in zip(first[length > MAX_ROUND].tolist(), length[length > MAX_ROUND].tolist(), strict=True):
            self._merge_long(out[a : a + n])
        short = np.repeat((length > 1) & (length <= MAX_ROUND), length)
        place = np.flatnonzero(short)
        symbol, begins = out[place], starts[place]
        while len(place):
            joined = ~begins[1:]
            rank, into = self.look_up(symbol[:-1], symbol[1:])
            rank = np.append(np.where(joined, rank, NEVER), NEVER)
            segment = np.flatnonzero(begins)
            size = np.diff(segment, append=len(place))
            least = np.repeat(np.minimum.reduceat(rank, segment), size)
            wanted = (rank == least) & (least != NEVER)
            # Of overlapping pairs every other one, counted from the left of its run.
            run = np.flatnonzero(wanted & ~np.concatenate(([False], wanted[:-1])))
            at = np.flatnonzero(wanted)
            since = at - run[np.searchsorted(run, at, "right") - 1]
            at = at[since % 2 == 0]
            merged = into[at]
            keep = self._in_order(at, merged, symbol, begins, segment, least)
            at, merged = at[keep], merged[keep]
            symbol[at] = merged
            out[place[at]] = merged
            out[place[at + 1]] = GONE
            stay = least != NEVER
            stay[at + 1] = False
            place, symbol, begins = place[stay], symbol[stay], begins[stay]

    def _in_order(self, at: np.ndarray, merged: np.ndarray, symbol: np.ndarray, begins: np.ndarray, segment: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which merges may happen at once: those of a segment up to the first that makes a pair of the same rank or a lesser."""
        own = np.searchsorted(segment, at, "right") - 1
        keep = np.ones(len(at), bool)
        followed = np.concatenate((own[1:] == own[:-1], [False]))
        k = np.flatnonzero(followed)
        if not len(k):
            return keep
        i, new = at[k], merged[k]
        # The left neighbour is what the merge just before made, if that was next to this one.
        beside = np.concatenate(([False], (at[1:] - at[:-1] == 2) & (own[1:] == own[:-1])))[k]
        left = np.where(beside, merged[k - 1], symbol[i - 1])
        to_left, _ = self.look_up(left, new)
        to_right, _ = self.look_up(new, symbol[np.minimum(i + 2, len(symbol) - 1)])
        before = least[i]
        wait = (~begins[i] & (to_left <= before)) | (to_right <= before)
        stops = np.zeros(len(at), np.int64)
        stops[k] = wait
        so_far = np.cumsum(stops) - stops
        head = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        return so_far == np.repeat(so_far[head], np.diff(head, append=len(at)))

    def _merge_long(self, out: np.ndarray) -> None:
        """One segment, pair by pair in the order of rank and place."""
        symbol = out.tolist()
        n = len(symbol)
        after, back = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self.table()
        heap = [(table[key][0], i, table[key][1], *key) for i, key in enumerate(zip(symbol, symbol[1:], strict=False)) if key in table]
        heapify(heap)
        while heap:
            _, i, into, a, b = heappop(heap)
            j = after[i] if symbol[i] == a else n
            if j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = into, GONE
            after[i] = after[j]
            if after[i] < n:
                back[after[i]] = i
            for k in (back[i], i):
                m = after[k] if k >= 0 else n
                if m < n and (key := (symbol[k], symbol[m])) in table:
                    heappush(heap, (table[key][0], k, table[key][1], *key))
        out[:] = symbol

    @cache  # noqa: B019  # one instance per model and worker
    def table(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and merged piece by pair."""
        left, right = (self.keys // self.size).tolist(), (self.keys % self.size).tolist()
        return dict(zip(zip(left, right, strict=True), zip(self.rank.tolist(), self.into.tolist(), strict=True), strict=True))

    def _written(self, out: np.ndarray, points: np.ndarray, ends: np.ndarray) -> list[bytes]:
        place = np.flatnonzero(out != GONE)
        ids = out[place].astype("<u4")
        unknown = np.flatnonzero(out[place] == -1)
        count = np.ones(len(place), np.int64)
        if len(unknown):
            coded = [chr(c).encode() for c in points[place[unknown]].tolist()]
            count[unknown] = list(map(len, coded))
            ids = np.repeat(ids, count)
            begin = np.cumsum(count) - count
            spread = np.repeat(begin[unknown] - np.concatenate(([0], np.cumsum(count[unknown])[:-1])), count[unknown]) + np.arange(count[unknown].sum())
            ids[spread] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        upto = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(place, ends)] * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of the given words and others: words that are not kept yet go through the rounds together; long ones are kept for this once."""
        asked = set(words)
        for w in self.long:
            self.words.pop(w, None)
        new = list(asked - self.words.keys())
        if len(self.words) + len(new) > MAX_WORDS:
            # Only words of now stay.
            self.words = {w: self.words[w] for w in asked & self.words.keys()}
        self.words.update(zip(new, self.encode(new), strict=True))
        self.long = [w for w in new if len(w) > MAX_CHARS]
        return self.words


@cache
def pieces(path: str) -> Pieces:
    """A worker's tables for a model file."""
    return Pieces(path)


def _texts_to_ids(model: Pieces, texts: list[str | None]) -> Iterator[bytes]:
    """Ids of each text; words of many texts, or of a part of a long one, are coded together."""
    ends = [np.array([i], "<u4").tobytes() for i in (model.begin, model.end)]
    coded: list[list[bytes]] = [[ends[0]] for _ in texts]
    window: list[tuple[int, list[str]]] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        ids = model.learn(w for _, ws in window for w in ws)
        for k, ws in window:
            coded[k].append(b"".join(map(ids.__getitem__, ws)))
        window.clear()
        waiting = 0

    for k, text in enumerate(texts):
        words = model.cuts(text or "")
        while part := list(islice(words, WINDOW)):
            window.append((k, part))
            waiting += len(part)
            if waiting >= WINDOW:
                flush()
    flush()
    return (b"".join((*parts, ends[1])) for parts in coded)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``ids``: the ids of each whole text, begin and end included, as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_texts_to_ids(own, texts), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def text_of(model: Pieces, ids: np.ndarray) -> str:
    """The text of ids: control ids are nothing but end a run of bytes, and a space that the first piece has in front goes."""
    stops = np.flatnonzero(model.control[ids])
    first = np.flatnonzero(~model.control[ids[: len(stops) + 1]])
    parts = (b"".join(map(model.shown.__getitem__, ids[a:b].tolist())) for a, b in zip([0, *stops.tolist()], [*stops.tolist(), len(ids)], strict=True))
    text = "".join(part.decode("utf-8", "piecewise") for part in parts)
    return text[1:] if len(first) and int(ids[first[0]]) in model.spaced else text


def decode(coded: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the text of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            texts = (text_of(own, np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    shown = coded.select("doc_id", "ids")
    return shown.mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
