"""Resharding by a minimum-cost flow from old shard sizes to new capacities.

Documents lie in old shards of any sizes and shall lie in new shards of nearly equal bytes.  A flow network has
a node per old and per new shard; keeping a byte where it is costs nothing, moving it costs one.  The flow of
least cost says how many bytes each old shard sends to each new one.  Documents travel in blocks: an old shard
is cut by a hash into blocks of about equal size, of which there are ``MAX_BLOCKS`` at most in all, so the block table that
the driver sees has a fixed bound.  Blocks are chosen to fill each flow; only files of shards that gain or lose are rewritten.

A row is named by ``row_key``, a digest of all its columns.  Rows of one key are alike in every column, so any of them may take any of
their places; a number of the row as first written enters the blocks' hash, so many copies of one row spread like other rows.

Nulls: a null text counts no bytes, so the row's size is 8.  Null and repeated ``doc_id`` are placed and rewritten row by row.
Equal texts need not share a shard.  Other columns only enter ``row_key``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, gapless_rank

MAX_BLOCKS = 65_536


def min_cost_flow(n_nodes: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge ``(from, to, capacity, cost)`` of a largest flow of least cost, by successive shortest paths."""
    to, room, cost, out = [], [], [], [[] for _ in range(n_nodes)]
    for a, b, c, w in edges:
        for node, (x, r, v) in ((a, (b, c, w)), (b, (a, 0, -w))):
            out[node].append(len(to))
            to.append(x), room.append(r), cost.append(v)
    while True:
        far, back, queue, queued = [float("inf")] * n_nodes, [-1] * n_nodes, deque([source]), [False] * n_nodes
        far[source] = 0
        while queue:
            a = queue.popleft()
            queued[a] = False
            for e in out[a]:
                if room[e] and far[a] + cost[e] < far[to[e]]:
                    far[to[e]], back[to[e]] = far[a] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if back[sink] < 0:
            return [room[2 * i + 1] for i in range(len(edges))]
        path, node = [], sink
        while node != source:
            path.append(back[node])
            node = to[back[node] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def transfers(old: dict[int, int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard; shards of the same number are the same place."""
    olds = sorted(old)
    first, source = len(olds), len(olds) + len(capacity)
    edges = [(source, i, old[s], 0) for i, s in enumerate(olds)]
    edges += [(first + j, source + 1, c, 0) for j, c in enumerate(capacity)]
    cross = [(i, first + j, min(old[s], c), int(s != j)) for i, s in enumerate(olds) for j, c in enumerate(capacity)]
    flow = min_cost_flow(source + 2, edges + cross, source, source + 1)[len(edges) :]
    return {(olds[i], j - first): f for (i, j, _, _), f in zip(cross, flow, strict=True) if f}


def choose_blocks(blocks: list[tuple[int, int, int, int]], n_shards: int) -> dict[tuple[int, int], int]:
    """New shard of each block ``(old, block, bytes, rows)``.

    Large blocks first, each goes to the flow of its old shard with most bytes left, staying put where that ties.
    What rounding to blocks leaves over is evened out by moving small blocks from the fullest to the emptiest shard.
    """
    old: dict[int, int] = {}
    for s, _, size, _ in blocks:
        old[s] = old.get(s, 0) + size
    total = sum(old.values())
    capacity = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    left: dict[int, dict[int, int]] = {}
    for (s, j), f in transfers(old, capacity).items():
        left.setdefault(s, {})[j] = f
    placed, held, fill = {}, [[] for _ in range(n_shards)], [0] * n_shards
    for s, b, size, _ in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        flows = left.get(s) or {min(range(n_shards), key=fill.__getitem__): 0}
        j = max(flows, key=lambda j: (flows[j], j == s, -j))
        flows[j] -= size
        placed[s, b] = j
        fill[j] += size
        held[j].append((size, s, b))
    for _ in range(8 * n_shards):
        full, empty = max(range(n_shards), key=fill.__getitem__), min(range(n_shards), key=fill.__getitem__)
        gap = fill[full] - fill[empty]
        best = min(held[full], key=lambda x: (abs(gap - 2 * x[0]), x[1] == full), default=(0, 0, 0))
        if not 0 < best[0] < gap:
            break
        held[full].remove(best)
        held[empty].append(best)
        fill[full], fill[empty] = fill[full] - best[0], fill[empty] + best[0]
        placed[best[1:]] = empty
    return placed


def row_key(docs: DataFrame) -> Column:
    """A digest of all columns: equal for two rows if and only if they are alike in each."""
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.unhex(F.sha2(F.to_json(whole, exact), 256))


def reshard(docs: DataFrame, old_shard: Column, n_shards: int, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``doc_id, size, text_crc32, old_shard, shard, slot, row_key`` of every row.

    ``old_shard`` is a non-negative integer column over the columns of ``docs``, with few distinct values.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
        row_key(docs).alias("row_key"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = Scratch(spark, "flow-reshard").save(rows, "rows")
    sizes = {r["old_shard"]: r["n"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("n")).collect()}
    total = max(1, sum(sizes.values()))
    cuts = [(s, max(1, (max_blocks - len(sizes)) * n // total)) for s, n in sizes.items()]
    cut = F.broadcast(spark.createDataFrame(cuts, "old_shard int, n_blocks long"))  # a row per old shard
    in_block = rows.join(cut, "old_shard").withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "rid"), F.col("n_blocks"))).drop("n_blocks")
    table = in_block.groupBy("old_shard", "block").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()  # max_blocks rows at most
    blocks = [(r["old_shard"], r["block"], r["n"], r["rows"]) for r in table]
    placed, used, plan = choose_blocks(blocks, n_shards), [0] * n_shards, []
    for s, b, _, n in sorted(blocks):
        j = placed[s, b]
        plan.append((s, b, j, used[j]))
        used[j] += n
    to = F.broadcast(spark.createDataFrame(plan, "old_shard int, block long, shard int, base long"))
    rank = F.row_number().over(Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size", "row_key", "rid")) - 1
    dealt = in_block.withColumn("rank", rank).join(to, ["old_shard", "block"])
    return dealt.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("rank")).alias("slot"), "row_key")


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write the new shards that differ from the old ones below ``path`` as ``shard=N``, and leave the others.

    ``placed`` is what ``reshard`` gave for ``docs``.  A shard that gave up all its rows loses its folder.  A ``shard`` or ``slot`` that
    ``docs`` has from its old place is replaced.  Returns the numbers of the shards that changed.
    """
    spark = docs.sparkSession
    moved = placed.filter(F.col("old_shard") != F.col("shard")).select(F.explode(F.array("old_shard", "shard")).alias("shard"))
    affected = sorted(r["shard"] for r in moved.distinct().collect())  # a row per shard
    to = placed.filter(F.col("shard").isin(affected)).select(F.col("row_key").alias("_key"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    filled = {r["_shard"] for r in to.select("_shard").distinct().collect()}  # a row per shard
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    # The k-th of rows that are alike goes to the k-th of their places: any order will do, as long as a task run again finds the same.
    n_rows = placed.count()
    rows = docs.select(*kept, row_key(docs).alias("_key")).join(to.select("_key").distinct(), "_key", "left_semi")
    numbered = Scratch(spark, "flow-rewrite").save(rows.withColumn("_order", F.monotonically_increasing_id()), "rows")
    rows = gapless_rank(numbered, ["_key"], ["_order"], n_rows, "_copy").drop("_order")
    to = gapless_rank(to.withColumn("_order", F.struct("_shard", "_slot")), ["_key"], ["_order"], n_rows, "_copy").drop("_order")
    rows = rows.join(to, ["_key", "_copy"]).select(*kept, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for shard in affected:
        if shard not in filled:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
            old.getFileSystem(conf).delete(old, True)
    return affected
