"""How far the sources of a language differ in their words: an audit over the count matrix of groups and terms.

Rows of a language's matrix are its sources, columns the terms in at least ``MIN_DOCS`` of its documents.  Each cell has a
smoothed share in whole numbers, ``1 + floor(10**9 * (count + 5) / (N + 5 V))``; a group's cells of count zero all have one.

The matrix is dealt out in blocks of columns and of rows.  A task puts the cells of its block into a K-squared quadtree
(k = 2): each level lists the quadrants that are not all zero, from the whole block down to leaves of eight rows by eight columns.  The distance
of two rows is then what two rows of zeros would have, plus corrections for what is not zero:

* against an all-zero quadrant of the other row, a row's cells are priced analytically, from sums over its sorted shares;
* leaves that are not zero in both are found by walking the tree jointly for pairs of row nodes over one column node, and
  only those are compared cell by cell.

Pairs are summed over the blocks.  All arithmetic is on whole numbers, exact for up to 9 * 10**15 words a language.

Nulls: null text, language and source count as ''.  Every group that occurs has its rows, also without terms or words; repeated
rows and null ids count row by row; other columns do not matter.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A language keeps the terms in at least so many of its documents; a group shows so many terms.
MIN_DOCS, TOP_TERMS = 30, 50
SMOOTH, SCALE = 5, 10**9
#: Columns of a block on average, rows of a block (a power of two), and the side of a leaf.
COLUMNS, ROWS, LEAF = 4096, 512, 8
#: Entries of a task's counts, bytes of a text and pairs of leaves that are looked at together.
MAX_ENTRIES, SLICE, PAIRS = 1_000_000, 1 << 20, 2048
#: Letters stay, A-Z in lower case, and so does all beyond ASCII; the rest separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text = text.translate(LETTERS)
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + SLICE)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].split()
        at = cut


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` as far as each task gets; a row without a term names each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), (n, docs_of) in held.items():
                terms = [b"", *n]
                for column, values in zip(columns, ([lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *map(docs_of.__getitem__, n)]), strict=True):
                    column.extend(values)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n, docs_of = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for terms in slices(text.encode()):
                    n.update(terms)
                    own.update(terms)
                docs_of.update(own)
            if sum(len(n) for n, _ in held.values()) > MAX_ENTRIES:
                yield flush()
        yield flush()

    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return named.mapInArrow(run, COUNTED)


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + 5) / (total + 5 terms))`` (5 * SCALE + 1 for a language without terms, where it prices nothing) by long division to the base 1000, so that no product overflows."""
    below = F.greatest(total + SMOOTH * terms, F.lit(1))
    rest, whole = n + SMOOTH, F.lit(0).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + div(rest, below)
        rest = F.pmod(rest, below)
    # A share of one or more has its whole part in front.
    return F.lit(1) + whole


def quadrants(rows: np.ndarray, columns: np.ndarray, levels: int) -> list[np.ndarray]:
    """Per level, from the root to the leaves, the quadrants that are not all zero, as sorted ``column << 32 | row``."""
    found = []
    for k in range(levels, -1, -1):
        shift = k + LEAF.bit_length() - 1
        found.append(np.unique((columns >> shift) << 32 | rows >> shift))
    return found


def _has(nodes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    return nodes[np.minimum(np.searchsorted(nodes, asked), len(nodes) - 1)] == asked


def joint_leaves(tree: list[np.ndarray], half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row nodes ``x <= y`` and column node of every pair of leaves in one stripe of columns, by walking the tree from its root.

    ``half``: only pairs of one of so many first rows with one of the others; 0: all pairs.
    """
    x, y, c = (np.zeros(1, np.int64) for _ in range(3))
    for depth, nodes in enumerate(tree[1:], 1):
        i, j, k = (a.ravel() for a in np.meshgrid([0, 1], [0, 1], [0, 1], indexing="ij"))
        x, y, c = ((a[:, None] * 2 + b).ravel() for a, b in ((x, i), (y, j), (c, k)))
        side = LEAF << (len(tree) - 1 - depth)
        keep = (x <= y) & _has(nodes, c << 32 | x)
        if half and side <= half:
            keep &= (x * side < half) & (y * side >= half)
        x, y, c = x[keep], y[keep], c[keep]
        keep = _has(nodes, c << 32 | y)
        x, y, c = x[keep], y[keep], c[keep]
    return x, y, c


def distances(rows: np.ndarray, columns: np.ndarray, shares: np.ndarray, zero: np.ndarray, half: int = 0) -> np.ndarray:
    """Sums of ``|p - q|`` for all pairs of rows ``g < h``, less what they would be with zeros only; the rest of the matrix is not filled.

    ``zero`` has each row's share for a count of zero; ``half`` is as in ``joint_leaves``.
    """
    n = len(zero)
    out = np.zeros((n, n), np.int64)
    if not len(rows):
        return out
    # Against zeros: a row's shares in order, and how much of their sum lies above each other row's zero.
    order = np.lexsort((shares, rows))
    begin = np.searchsorted(rows[order], np.arange(n + 1))
    for g in np.flatnonzero(np.diff(begin)).tolist():
        own = shares[order[begin[g] : begin[g + 1]]]
        sums = np.concatenate(([0], np.cumsum(own)))
        below = np.searchsorted(own, zero)
        far = (sums[-1] - 2 * sums[below]) + zero * (2 * below - len(own)) - len(own) * np.abs(zero[g] - zero)
        out[g, :] += far
        out[:, g] += far
    levels = max(0, (int(max(rows.max(), columns.max(), half)) // LEAF).bit_length())
    tree = quadrants(rows, columns, levels)
    leaves = tree[-1]
    padded = np.zeros((max(n, int(rows.max()) + 1) + LEAF) // LEAF * LEAF, np.int64)
    padded[:n] = zero
    zeros = padded.reshape(-1, LEAF)
    tiles = np.repeat(zeros[leaves & 0xFFFFFFFF][:, :, None], LEAF, axis=2)
    tiles[np.searchsorted(leaves, (columns // LEAF) << 32 | rows // LEAF), rows % LEAF, columns % LEAF] = shares
    x, y, c = joint_leaves(tree, half)
    order = np.lexsort((y, x))
    x, y, c = x[order], y[order], c[order]
    summed = np.zeros((len(padded), len(padded)), np.int64)
    for at in range(0, len(x), PAIRS):
        a, b, k = x[at : at + PAIRS], y[at : at + PAIRS], c[at : at + PAIRS]
        p, q = tiles[np.searchsorted(leaves, k << 32 | a)][:, :, None, :], tiles[np.searchsorted(leaves, k << 32 | b)][:, None, :, :]
        p0, q0 = zeros[a][:, :, None, None], zeros[b][:, None, :, None]
        more = (np.abs(p - q) - np.abs(p - q0) - np.abs(q - p0) + np.abs(p0 - q0)).sum(axis=3)
        head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        more = np.add.reduceat(more, head, axis=0)
        for u, v, m in zip(a[head].tolist(), b[head].tolist(), more, strict=True):
            summed[u * LEAF : (u + 1) * LEAF, v * LEAF : (v + 1) * LEAF] += m
    return out + summed[:n, :n]


def _block(table: pa.Table, rows: int) -> pa.Table:
    """One block: what its cells add to the distance of each pair of its rows, ``rows`` or twice as many."""
    first = table.slice(0, 1).to_pylist()[0]
    r = table["r"].to_numpy()
    apart = first["ra"] != first["rz"]
    # Rows of the second block come after those of the first.
    place = r % rows + np.where(apart & (r // rows == first["rz"]), rows, 0)
    n = int(place.max()) + 1
    zero, known = np.zeros(n, np.int64), np.zeros(n, bool)
    names = np.empty(n, object)
    some = np.unique(place, return_index=True)[1]
    zero[place[some]], known[place[some]] = table["p0"].to_numpy()[some], True
    names[place[some]] = table["source"].take(pa.array(some)).to_pylist()
    filled = table.filter(table["term"].is_valid())
    cell = table["term"].is_valid().to_numpy().astype(bool)
    terms = filled["term"].combine_chunks().dictionary_encode()
    code = (terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms).indices.to_numpy().astype(np.int64)
    # Terms of many groups come first, so that what is not zero lies together.
    by_use = np.argsort(-np.bincount(code), kind="stable") if len(code) else code
    column = np.empty(len(by_use), np.int64)
    column[by_use] = np.arange(len(by_use))
    value = distances(place[cell], column[code], table["p"].to_numpy(zero_copy_only=False)[cell].astype(np.int64), zero, rows if apart else 0)
    if first["block"] == 0:
        value += first["v"] * np.abs(zero[:, None] - zero[None, :])
    wanted = np.triu(known[:, None] & known[None, :], 1)
    if apart:
        wanted &= (np.arange(n) < rows)[:, None] & (np.arange(n) >= rows)[None, :]
    g, h = np.nonzero(wanted)
    return pa.table({"lang": pa.array([first["lang"]] * len(g), pa.string()), "a": pa.array(names[g], pa.string()), "b": pa.array(names[h], pa.string()), "value": pa.array(value[g, h], pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """``lang, source, part, item, value, rank``: per group the distance to each other source of its language (part ``pair``),
    and the terms that it has more of than its language (part ``term``)."""
    scratch = Scratch(docs.sparkSession, "divergence")
    counted = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    column = Window.partitionBy("lang", "term")
    with_column = counted.withColumns({"all_docs": F.sum("docs").over(column), "all_n": F.sum("n").over(column), "first": F.row_number().over(column.orderBy("source")) == 1})
    kept = scratch.save(with_column.filter((F.col("term") == "") | (F.col("all_docs") >= min_docs)).drop("docs", "all_docs"), "cells")
    is_term = F.col("term") != ""
    languages = kept.groupBy("lang").agg(F.sum(F.when(is_term & F.col("first"), 1).otherwise(0)).alias("v"), F.sum("n").alias("lang_n"), F.sum(F.when(is_term, 0).otherwise(1)).alias("sources"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(languages, "lang")
    numbered = Window.partitionBy("lang").orderBy(F.desc("total"), "source")
    groups = scratch.save(groups.withColumn("r", F.row_number().over(numbered) - 1), "groups")
    most = groups.agg(F.max("v")).first()[0] or 0
    blocks = max(1, -(-most // columns))
    # Each group has a row in each block; so the join's keys hold one block of a group's cells at most.
    spread = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    cells = kept.filter(is_term).withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")).drop("first")
    joined = spread.join(cells, ["lang", "source", "block"], "left")
    shares = joined.withColumn("p", F.when(F.col("term").isNotNull(), share(F.col("n"), F.col("total"), F.col("v"))))
    shares = scratch.save(shares.withColumn("q", F.when(F.col("term").isNotNull(), share(F.col("all_n"), F.col("lang_n"), F.col("v")))), "shares")
    last = F.ceil(F.col("sources") / rows).cast("int") - 1
    own, other = F.expr(f"cast(r div {rows} as int)"), F.explode(F.sequence(F.lit(0), last))
    pairs = shares.withColumn("own", own).withColumn("other", other).withColumns({"ra": F.least("own", "other"), "rz": F.greatest("own", "other")})
    parts = pairs.select("lang", "block", "ra", "rz", "source", "r", "p0", "term", "p", "v").groupBy("lang", "block", "ra", "rz").applyInArrow(lambda block: _block(block, rows), "lang string, a string, b string, value long")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    far = summed.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    more = shares.filter((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = more.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms)
    return far.withColumn("rank", F.row_number().over(ranked)).unionByName(top)
