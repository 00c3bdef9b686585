"""N-gram Jaccard join by size: subsets for small sets, inverted lists for large ones.

A document's set holds the hashes of its distinct five-word shingles.  Two sets of a Jaccard similarity of ``t`` overlap in at
least ``ceil(t * n)`` of the ``n`` elements of either.  Under any one order of all elements they therefore share

* one of the first ``n - ceil(t * n) + 1`` elements of each, which an inverted list of these elements finds, and
* two of the first ``n - ceil(t * n) + 2``, which a table of the two-element subsets of these finds.

Sets up to a boundary size enumerate subsets, larger ones enter inverted lists, and small ones that a large one may resemble
do both.  The boundary is the one of least cost, from sums over all documents of what either way would emit and scan.  Elements
are ordered by a table of hashed counts over all documents, rare ones first, so that passages which many documents
share stand at the end and hardly ever make candidates.

Equal sets are one class and compared once.  A list is never expanded into all pairs: its members are first compared with one
of them, links are joined into components, and lists of one component are finished.  The sets of the other lists are few; they are listed again with elements
ordered by exact counts among them, where sets that share passages only, or elements by chance, no longer meet.  Members are compared with the centres of these lists, and
only pairs of a list that are still in different components one by one.  At each step pairs are left out that sizes or the
element's place in either order rule out.  Of the others, sketches of the prefixes bound how much two sets can share, and
texts are read only where that allows a link.  So every link between documents of different components would be
found, and the components are exact up to collisions of 64-bit hashes.

Nulls: documents without words, with a null text too, have an empty set, link with nothing and are their own component; a null
``doc_id`` is no component's smallest id unless all its ids are null.  Repeated rows are documents of equal sets.  Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .bloom import mix64
from .common import BLANKS, Scratch, add_up, pack, pack_sorted, unpack, unpack_sorted, with_row_key
from .components import connect

WORDS = 5
#: Similarity of at least 75 in 100.
PERCENT = 75
#: Elements of a part of the exact counts.
PART = 1_000_000
#: Prefixes from so many elements on have four bytes an element in their sketch, others two.
WIDE = 4096
#: The count table has ``2 ** TABLE_BITS`` classes: a megabyte for the driver and each worker at any input size.
TABLE_BITS = 17
BOUNDARIES = (0, 4, 8, 16, 32, 64)
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


#: Bytes of text hashed together.
SLICE = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts in order, A-Z lower-cased; and how many words each text has.

    Words are read eight bytes at a time, the first eight of all, then the next eight of those that are longer, and so on.
    """
    joined = b" ".join([(t or b"").lower() for t in texts])
    data = np.frombuffer(joined + b" " * 8, np.uint8)
    blank = _BLANK[data[: len(joined) + 1]]
    turns = np.flatnonzero(np.diff(blank, prepend=True))
    starts, stops = turns[::2], turns[1::2]
    eight = np.ndarray((len(joined) + 1,), "<u8", data, strides=(1,))
    left = stops - starts
    out = mix64(mix64(eight[starts] & _FIRST[np.minimum(left, 8)]) + left.astype(np.uint64))
    at = np.flatnonzero(left > 8)
    done = 8
    while len(at):
        out[at] = mix64(out[at] * _MULTIPLIER + (eight[starts[at] + done] & _FIRST[np.minimum(left[at] - done, 8)]))
        done += 8
        at = at[left[at] > done]
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
    return out, np.diff(np.searchsorted(starts, ends), prepend=0)


def shingle_hashes(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """Hashes of the shingles of each text, in order and with repetitions.

    A shingle of hashed words is a polynomial in a fixed odd number; texts of fewer words are one shingle of another length.
    """
    flat, sizes = word_hashes(texts)
    rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            rolled *= _MULTIPLIER
            rolled += flat[k : k + len(rolled)]
        rolled = mix64(rolled)
        out, at = [], 0
        for n in sizes.tolist():
            if n >= words:
                out.append(rolled[at : at + n - words + 1])
            elif n:
                short = np.uint64(n)
                for h in flat[at : at + n]:
                    short = short * _MULTIPLIER + h
                out.append(mix64(np.array([~short])))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """In order."""
    items = np.sort(hashes)
    return items[np.concatenate(([True], items[1:] != items[:-1]))] if len(items) else items


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return _distinct(shingle_hashes([text], words)[0])


def _slices(batch: pa.RecordBatch) -> Iterator[list[bytes | None]]:
    own, size = [], 0
    for text in _texts(batch):
        own.append(text)
        size += len(text or b"")
        if size >= SLICE:
            yield own
            own, size = [], 0
    if own:
        yield own


def _overlap(n: int) -> int:
    return -(-PERCENT * n // 100)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def count_table(docs: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """How often an element of each of ``2 ** bits`` hash classes occurs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for texts in _slices(batch):
                hashes = np.concatenate(shingle_hashes(texts))
                own += np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["i", "n"])

    merged = docs.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[merged["i"].to_numpy()] = merged["n"].to_numpy()
    return out


def signatures(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``rk, doc_id, n, fp1, fp2, prefix, scan_cost`` of each document.

    An element in ``prefix`` is the rank of its class above 48 bits of its hash, so numbers compare as the order goes.
    """
    bits = int(len(counts)).bit_length() - 1
    usual = int(np.median(counts))
    # The order's main key in 16 bits: how far a class is above half the usual count, in fine steps.
    step = max(1, usual // 512)
    held = docs.sparkSession.sparkContext.broadcast(np.clip((counts - usual // 2) // step, 0, 65535).astype(np.uint64) << np.uint64(48))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, top = held.value, np.uint64(64 - bits)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        for batch in batches:
            out: list[tuple] = []
            for texts in _slices(batch):
                for hashes in shingle_hashes(texts):
                    items = _distinct(hashes)
                    n = len(items)
                    keep = max(0, n - _overlap(n) + 2)
                    order = ranks[(items >> top).view(np.int64)] | items >> np.uint64(16)
                    if keep < n:
                        order.partition(keep - 1)
                    order = np.sort(order[:keep])
                    above = (order[: keep - 1] >> np.uint64(48)).view(np.int64) * step + (usual // 2 - usual)
                    digest = xxhash.xxh3_128_digest(items.tobytes())
                    out.append((n, *np.frombuffer(digest, np.int64).tolist(), order.tobytes(), int(np.maximum(1, above).sum())))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("rk"), batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["rk", "doc_id", "n", "fp1", "fp2", "prefix", "scan_cost"]
            )

    return docs.select("rk", F.col("doc_id").cast("long"), "text").mapInArrow(sign, "rk long, doc_id long, n int, fp1 long, fp2 long, prefix binary, scan_cost long")


def choose_boundary(classes: DataFrame) -> int:
    """The size up to which sets enumerate subsets, by the sum of what sets would emit and scan."""
    first = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 2
    subsets = first * (first - 1) / 2
    costs = [
        (F.sum(F.when(F.col("n") <= b, subsets).otherwise(0)) + F.sum(F.when(100 * F.col("n") >= PERCENT * (b + 1), 2 * F.col("scan_cost")).otherwise(0))).alias(str(b))
        for b in BOUNDARIES
    ]
    row = classes.filter("n >= 3").agg(*costs).first()
    return min(BOUNDARIES, key=lambda b: (row[str(b)] or 0, b))


def keys(classes: DataFrame, boundary: int, only: np.ndarray | None = None) -> DataFrame:
    """``key, rep, n, pos``: the inverted lists' elements and the subsets' hashes of each class; those in the filter ``only``.

    ``pos`` is the place of the element, or of the subset's first, in the class's order.
    """
    held = classes.sparkSession.sparkContext.broadcast(only)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, sizes = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            found, places = [], []
            for n, raw in zip(sizes.tolist(), batch.column("prefix").to_pylist(), strict=True):
                items, own, at = np.frombuffer(raw, np.uint64), [], []
                if 100 * n >= PERCENT * (boundary + 1):
                    own.append(items[: n - _overlap(n) + 1])
                    at.append(np.arange(len(own[0]), dtype=np.int32))
                if n <= boundary:
                    i, j = np.triu_indices(len(items), 1)
                    a, b = np.minimum(items[i], items[j]), np.maximum(items[i], items[j])
                    with np.errstate(over="ignore"):
                        own.append(mix64(a * _MULTIPLIER) + b)
                    at.append(i.astype(np.int32))
                found.append(np.concatenate(own))
                places.append(np.concatenate(at))
            if found:
                if held.value is not None:
                    fit = [bloom.maybe(held.value, x) for x in found]
                    found, places = [x[f] for x, f in zip(found, fit, strict=True)], [x[f] for x, f in zip(places, fit, strict=True)]
                times = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(reps, times)), pa.array(np.repeat(sizes, times)), pa.array(np.concatenate(places))], ["key", "rep", "n", "pos"])

    return classes.filter("n >= 3").select("rep", "n", "prefix").mapInArrow(emit, "key long, rep long, n int, pos int")


def texts_of(docs: DataFrame, rks: DataFrame) -> DataFrame:
    """``rk, words`` of the documents in ``rks`` (``rk``, distinct) and a few others: their words, compressed."""
    held = docs.sparkSession.sparkContext.broadcast(bloom.build(rks, rks.count()))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipped = zstandard.ZstdCompressor().compress
        for batch in batches:
            at = np.flatnonzero(bloom.maybe(held.value, batch.column("rk").to_numpy().view(np.uint64)))
            some = batch.take(pa.array(at))
            packed = [zipped(b" ".join((t or b"").lower().split())) for t in _texts(some)]
            yield pa.RecordBatch.from_arrays([some.column("rk"), pa.array(packed, pa.binary())], ["rk", "words"])

    return docs.select("rk", "text").mapInArrow(load, "rk long, words binary")


def sketches(classes: DataFrame) -> DataFrame:
    """``rep, n, last, sketch``: two or four bytes of each element of a class's prefix, and the prefix's last element."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, out = [], []
            for raw in batch.column("prefix").to_pylist():
                items = np.frombuffer(raw, np.uint64)
                last.append((items[-1] ^ np.uint64(1 << 63)).view(np.int64))  # in the same order as a signed number
                out.append(items.astype("<u2" if len(items) < WIDE else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array(last, pa.int64()), pa.array(out, pa.binary())], ["rep", "n", "last", "sketch"])

    return classes.filter("n > 0").select("rep", "n", "prefix").mapInArrow(shorten, "rep long, n int, last long, sketch binary")


def most_common(n: int, last: int, p: np.ndarray, m: int, end: int, q: np.ndarray) -> int:
    """At most so many elements do two sets have in common, given their sizes and their prefixes' last elements and sketches.

    The prefix that ends first in the order is held against all that the other set has up to there.  Its elements that the other's sketch lacks
    are not in the other set.  Elements of one sketch value only make the bound larger.
    """
    if p.itemsize != q.itemsize:
        p, q = p.astype(np.uint16), q.astype(np.uint16)
    if last > end:
        n, p, m, q = m, q, n, p
    return min(n - len(p) + int(np.isin(p, q).sum()), m)


def bounded(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """``a, b, most, n, m`` of each pair: at most how many elements are common, and the sizes of both."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_pylist(), batch.column("m").to_pylist()
            found = []
            for i, j, last, end, x, y in zip(n, m, *(batch.column(c).to_pylist() for c in ("last", "end", "x", "y")), strict=True):
                p, q = (np.frombuffer(s, "<u2" if size - _overlap(size) + 2 < WIDE else "<u4") for s, size in ((x, i), (y, j)))
                found.append(most_common(i, last, p, j, end, q))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.int32()), batch.column("n"), batch.column("m")], ["a", "b", "most", "n", "m"])

    x = sketched.select(F.col("rep").alias("a"), "n", "last", F.col("sketch").alias("x"))
    y = sketched.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("last").alias("end"), F.col("sketch").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "n", "m", "last", "end", "x", "y").mapInArrow(bound, "a long, b long, most int, n int, m int")


def compare(pairs: DataFrame, docs: DataFrame, sketched: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``a, b, linked`` of each pair: whether they link.

    Pairs whose sketches allow no link have no text read; the others' whole texts are compared.
    """
    found = scratch.save(bounded(pairs, sketched), f"bounded-{name}")
    possible = F.col("most") >= F.ceil(PERCENT * (F.col("n") + F.col("m")) / (100 + PERCENT))
    apart = found.filter(~possible).select("a", "b", F.lit(False).alias("linked"))
    close = found.filter(possible).select("a", "b")
    texts = scratch.save(texts_of(docs, close.select(F.explode(F.array("a", "b")).alias("rk")).distinct()), f"texts-{name}")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, last, p = zstandard.ZstdDecompressor().decompress, None, None
        for batch in batches:
            linked = []
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "x", "y")), strict=True):
                if a != last:
                    last, p = a, shingle_set(unzip(x))
                q = shingle_set(unzip(y))
                both = np.sort(np.concatenate((p, q)))
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= PERCENT * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    x, y = (texts.select(F.col("rk").alias(c), F.col("words").alias(t)) for c, t in (("a", "x"), ("b", "y")))
    measured = close.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(measure, "a long, b long, linked boolean")
    out = scratch.save(apart.unionByName(measured), f"checked-{name}")
    scratch.drop(f"bounded-{name}", f"texts-{name}")
    return out


def _fit(p: str, q: str) -> str:
    """Whether two members of a list can be similar: by their sizes, and by how much of each order is left from the element on."""
    n, m, i, j = (f"{p}n", f"{q}n", f"{p}pos", f"{q}pos")
    overlap = f"ceil({PERCENT} * ({n} + {m}) / {100 + PERCENT})"
    return f"(100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m}) AND {n} - {i} >= {overlap} AND {m} - {j} >= {overlap})"


def _lists(classes: DataFrame, boundary: int, scratch: Scratch) -> DataFrame:
    """``key, rep, n, pos`` and ``centre``, ``centre_n``, ``centre_pos``: the lists of several members, with the smallest as ``centre``.

    Most keys are alone; a first pass counts keys, and a filter of the others spares the rows of lonely ones the second shuffle.
    """
    several = keys(classes, boundary).groupBy("key").count().filter("count > 1").select("key")
    several = scratch.save(several, "several")
    members = keys(classes, boundary, bloom.build(several, several.count())).join(several, "key", "left_semi")
    members = scratch.save(members, "members")
    scratch.drop()
    heads = members.groupBy("key").agg(F.min(F.struct("rep", "n", "pos")).alias("best"), F.max("rep").alias("most")).filter("best.rep <> most")
    heads = scratch.save(heads.select("key", F.col("best.rep").alias("centre"), F.col("best.n").alias("centre_n"), F.col("best.pos").alias("centre_pos")), "heads")
    return scratch.save(members.join(heads, "key"), "lists")


def _classes_and_links(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Size and fingerprint of each row, classes, and ``rep, label`` of the classes that links join."""
    signed = scratch.save(signatures(keyed, count_table(keyed)), "signed", compression="zstd")
    one = signed.groupBy("fp1", "fp2").agg(F.min("rk").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("scan_cost").alias("scan_cost"))
    full = scratch.save(one, "classes", compression="zstd")
    rows = scratch.save(signed.select("rk", "doc_id", "n", "fp1", "fp2"), "rows")
    classes = scratch.save(full.select("fp1", "fp2", "rep"), "reps")
    scratch.drop("signed")
    lists = _lists(full, choose_boundary(full), scratch)
    sketched = scratch.save(sketches(full.join(lists.select("rep").distinct(), "rep", "left_semi")), "sketches")
    scratch.drop("classes", "several", "members", "heads")

    def check(pairs: DataFrame, name: str) -> DataFrame:
        return compare(scratch.save(pairs, f"pairs-{name}"), keyed, sketched, scratch, name)

    # First round: every member against its list's centre.
    pairs = lists.filter(f"rep <> centre AND {_fit('', 'centre_')}").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    checked = check(pairs, "1")
    labels = connect(checked.filter("linked").select("a", "b"), scratch, "round-1")
    open_lists = _open_lists(lists.select("key", "rep", "n"), labels, scratch, "open")
    scratch.drop("lists")
    if open_lists.isEmpty():
        return rows, classes, labels

    # What may still link lies in lists of several components.  Their sets alone are listed anew, in exact order.
    left = open_lists.groupBy("rep").agg(F.min("label").alias("label"), F.first("n").alias("n"))
    lists = _exact_lists(keyed, scratch.save(left, "left"), scratch)
    scratch.drop("open")

    # Second round: members against the centre of such a list.
    checked = checked.unionByName(check(_unchecked(_second(lists, scratch), checked), "2"))
    labels = connect(checked.filter("linked").select("a", "b"), scratch, "round-2")
    lists = _open_lists(lists.drop("label"), labels, scratch, "lists-3")
    scratch.drop("exact")
    if lists.isEmpty():
        return rows, classes, labels

    # Last: what is left of each list, between components.
    left, right = lists.alias("l"), lists.alias("r")
    apart = F.expr(f"l.label < r.label AND {_fit('l.', 'r.')}")
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & apart).select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).distinct()
    checked = checked.unionByName(check(_unchecked(pairs, checked), "3"))
    labels = connect(checked.filter("linked").select("a", "b"), scratch, "round-3")
    scratch.drop("lists-3", "sketches")
    return rows, classes, labels


def _wanted_sets(batch: pa.RecordBatch, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``rk`` and set size of some documents whose ``rk`` the filter ``held`` lets through, and 48 bits of each element, set after set."""
    some = batch.take(pa.array(np.flatnonzero(bloom.maybe(held, batch.column("rk").to_numpy().view(np.uint64)))))
    rks, done = some.column("rk").to_numpy(), 0
    for texts in _slices(some):
        found = [_distinct(h) for h in shingle_hashes(texts)]
        yield rks[done : done + len(found)], np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found) >> np.uint64(16)
        done += len(found)


def exact_counts(docs: DataFrame, held: np.ndarray, n_elements: int) -> DataFrame:
    """``key, df``: how many of the wanted sets have an element, for elements of two sets or more.

    A task adds up its own elements first and sends them in order, packed, to the parts of the hashes' range; there are so many parts that each gets some
    ``PART`` elements, however common one is.
    """
    sent, n_parts = docs.sparkSession.sparkContext.broadcast(held), min(max(1, n_elements // PART), 1 << 24)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([*own, np.empty(0, np.uint64)]), return_counts=True)
            own.clear()
            part = (keys >> np.uint64(24)) * np.uint64(n_parts) >> np.uint64(24)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(keys)] if len(keys) else []
            rows = [(int(part[a]), pack_sorted(keys[a:b]), pack(n[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "keys", "n"])

        for batch in batches:
            for _, _, items in _wanted_sets(batch, sent.value):
                own.append(items)
                if sum(map(len, own)) > 4 * PART:
                    yield flush()
        yield flush()

    def add(table: pa.Table) -> pa.Table:
        keys, n = add_up([unpack_sorted(k) for k in table["keys"].to_pylist()], [unpack(c).astype(np.int64) for c in table["n"].to_pylist()])
        several = n > 1
        return pa.table({"key": keys[several].astype(np.int64), "df": n[several]})

    return docs.select("rk", "text").mapInArrow(count, "part int, keys binary, n binary").groupBy("part").applyInArrow(add, "key long, df long")


def _exact_lists(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, rep, n, pos, label``: inverted lists of the sets ``wanted`` (``rep, label, n``), rarest elements first by exact counts among them.

    An element of one set only links nothing, so a set has lists for the rest of its prefix alone.  Sets that merely share a passage have elements enough
    of their own to fill their prefixes, and drop out here; in the order by hashed counts chance had mixed both.
    """
    spark = docs.sparkSession
    size = wanted.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("elements")).first()
    held = bloom.build(wanted.select("rep"), size["sets"])
    counts = scratch.save(exact_counts(docs, held, size["elements"]), "counts")
    scratch.drop()
    sent, shared = spark.sparkContext.broadcast(held), spark.sparkContext.broadcast(bloom.build(counts.select("key"), counts.count()))

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rks, sizes, items in _wanted_sets(batch, sent.value):
                # Sets with elements of their own for the whole prefix end here.
                fit = bloom.maybe(shared.value, items)
                others = np.diff(np.concatenate(([0], np.cumsum(fit)))[np.concatenate(([0], np.cumsum(sizes)))])
                fit &= np.repeat(sizes - others <= sizes + (-PERCENT * sizes) // 100, sizes)
                items, own = items[fit], np.repeat(rks, sizes)[fit]
                for k in range(0, len(items), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(items[k : k + 100_000].view(np.int64)), pa.array(own[k : k + 100_000])], ["key", "rep"])

    rows = docs.select("rk", "text").mapInArrow(elements, "key long, rep long").join(counts, "key").join(wanted, "rep")
    own = Window.partitionBy("rep")
    ranked = rows.withColumns({"rank": F.row_number().over(own.orderBy("df", "key")), "shared": F.count(F.lit(1)).over(own)})
    at = F.col("n") - F.col("shared") + F.col("rank") - 1
    out = scratch.save(ranked.withColumn("pos", at.cast("int")).filter(f"pos <= n - ceil({PERCENT} * n / 100)").select("key", "rep", "n", "pos", "label"), "exact")
    scratch.drop("counts", "left")
    return out


def _open_lists(lists: DataFrame, labels: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``lists`` with their members' ``label``, without the lists that lie in one component."""
    named = scratch.save(lists.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), f"{name}-named")
    several = named.groupBy("key").agg((F.min("label") != F.max("label")).alias("several"), F.count(F.lit(1)).alias("members"))
    several = scratch.save(several.filter("several AND members > 2").select("key"), f"{name}-keys")
    out = scratch.save(named.join(several, "key", "left_semi"), name)
    scratch.drop(f"{name}-named", f"{name}-keys")
    return out


def _second(lists: DataFrame, scratch: Scratch) -> DataFrame:
    best = F.min(F.struct(F.xxhash64("rep", F.lit(1)).alias("h"), "rep", "n", "pos", "label")).alias("best")
    heads = scratch.save(lists.groupBy("key").agg(best), "heads-2")
    pairs = lists.join(heads, "key").filter(f"label <> best.label AND {_fit('', 'best.')}")
    return pairs.select(F.col("best.rep").alias("a"), F.col("rep").alias("b")).distinct()


def _unchecked(pairs: DataFrame, checked: DataFrame) -> DataFrame:
    either = checked.select("a", "b").union(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(either, ["a", "b"], "left_anti")


def _labelled(docs: DataFrame, scratch: Scratch, whole: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with ``rk``; and ``rk, doc_id, n, label``, the label being the smallest ``rk`` of the component."""
    keyed = with_row_key(docs, ["doc_id", "text"], scratch, whole)
    rows, classes, labels = _classes_and_links(keyed, scratch)
    named = rows.join(classes, ["fp1", "fp2"]).join(labels, "rep", "left")
    label = F.when(F.col("n") == 0, F.col("rk")).otherwise(F.coalesce("label", "rep"))
    return keyed, named.select("rk", "doc_id", "n", label.alias("label"))


def ngram_jaccard(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    scratch = Scratch(docs.sparkSession, "ngram-jaccard")
    rows = scratch.save(_labelled(docs, scratch)[1], "labelled")
    smallest = scratch.save(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")), "smallest")
    return rows.join(smallest, "label").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the first row of each component."""
    scratch = Scratch(docs.sparkSession, "ngram-jaccard")
    keyed, rows = _labelled(docs, scratch, columns)
    stay = scratch.save(rows.filter("rk = label").select("rk"), "stay")
    return keyed.join(stay, "rk", "left_semi").select("row.*")
