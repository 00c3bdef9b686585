"""Quotation linking: find what messages quote, and order conversations by who replies to whom.

A line's quote level is the number of ``>`` before it.  Runs of lines of one level form quoted blocks, and runs between
blank lines paragraphs; blocks, paragraphs and single lines are normalised (lower case, blanks collapsed) and hashed.  Of the
text a message wrote itself, the whole, its blocks, paragraphs and lines are hashed alike.  A quoted unit links to the first
message of the same conversation that wrote it, if that came earlier.  The longest unit of the lowest level decides
the message replied to.  Following replies upwards by pointer doubling gives each message its thread and depth.
``conv_id, thread_root, turn`` is reply order: a message comes after the one it answers.

Only DataFrame functions are used.  Texts of originals are aggregated to one row per conversation and hash before the join, so a
passage that everybody quotes joins one row.

Nulls: a null text is empty.  A message with a null conversation or turn links with nothing and is its own thread.  Repeated
rows come out one by one; they share their parent.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Lines that introduce a quotation, such as "On Monday, A wrote:".
ATTRIBUTION = r"(?i)^(on|am|le|el)\b.*\b(wrote|schrieb|a écrit|escribió)\b.*:$"
#: A single line links only from this many characters on.
MIN_LINE = 20


def quote_lines(messages: DataFrame) -> DataFrame:
    """The lines of each message (``rk, conv_id, turn, text``) with their level and place in blocks and paragraphs."""
    line = F.col("line")
    lines = messages.select("rk", "conv_id", "turn", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("prefix", F.regexp_extract(line, r"^(?:[ \t]*>)*", 0))
    lines = lines.withColumn("level", F.length(F.regexp_replace("prefix", r"[^>]", "")))
    lines = lines.withColumn("body", F.expr("substr(line, length(prefix) + 1)"))
    lines = lines.withColumn("norm", F.trim(F.lower(F.regexp_replace("body", r"\s+", " "))))
    own = Window.partitionBy("rk").orderBy("pos")
    lines = lines.withColumn("intro", (F.col("level") == 0) & F.trim("body").rlike(ATTRIBUTION) & (F.coalesce(F.lead("level").over(own), F.lit(0)) > 0))
    turned = F.coalesce(F.col("level") != F.lag("level").over(own), F.lit(True))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("turned", turned.cast("int"))
    return lines.select(
        "rk", "conv_id", "turn", "pos", "level", "norm", "intro", F.rtrim("body").alias("body"),
        F.sum("turned").over(so_far).alias("block"),
        F.sum(F.greatest(F.col("turned"), (F.col("norm") == "").cast("int"))).over(so_far).alias("paragraph"),
    )


def hashed_units(lines: DataFrame) -> DataFrame:
    """``rk, conv_id, turn, level, kind, hash, n_chars`` of all units; kind m(essage), b(lock), p(aragraph) or l(ine)."""
    parts = [F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("part")) for k, c in (("b", "block"), ("p", "paragraph"), ("l", "pos"))]
    whole = F.when(F.col("level") == 0, F.struct(F.lit("m").alias("kind"), F.lit(0).cast("long").alias("part")))
    unit = F.explode(F.array_compact(F.array(*parts, whole))).alias("unit")
    rows = lines.filter("norm <> '' AND NOT intro").select("rk", "conv_id", "turn", "level", "pos", "norm", unit)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]), " ")
    units = rows.groupBy("rk", "conv_id", "turn", "level", "unit.kind", "unit.part").agg(text.alias("text"))
    return units.select("rk", "conv_id", "turn", "level", "kind", F.sha2("text", 256).alias("hash"), F.length("text").alias("n_chars"))


def _threads(replies: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, turn, thread_root, depth`` of messages with a parent (``conv_id, turn, parent_turn``), by pointer doubling."""
    up = scratch.save(replies.select("conv_id", "turn", F.col("parent_turn").alias("thread_root"), F.lit(1).alias("depth")), "up-0")
    for step in range(1, 64):
        above = up.select("conv_id", F.col("turn").alias("thread_root"), F.col("thread_root").alias("above"), F.col("depth").alias("more"))
        joined = up.join(above, ["conv_id", "thread_root"], "left")
        up = scratch.save(joined.select("conv_id", "turn", F.coalesce("above", "thread_root").alias("thread_root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), f"up-{step}")
        if up.filter("moved").isEmpty():
            break
        up = up.drop("moved")
    return up.select("conv_id", "turn", "thread_root", "depth")


def link_quotes(messages: DataFrame, min_line: int = MIN_LINE) -> DataFrame:
    """One row per message: ``conv_id, turn, role, reply, n_quotes, n_linked, parent_turn, thread_root, depth``.

    ``reply`` is the text without quotations; ``n_quotes`` counts quoted paragraphs, ``n_linked`` the earlier messages quoted.
    """
    scratch = Scratch(messages.sparkSession, "quote-linking")
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rk"))
    rows = scratch.save(rows, "messages")
    lines = quote_lines(rows)
    units = scratch.save(hashed_units(lines), "units")
    originals = units.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    quoted = units.filter(f"level > 0 AND (kind <> 'l' OR n_chars >= {int(min_line)})")
    linked = quoted.join(originals, ["conv_id", "hash"]).filter("source < turn")
    nearest = F.struct(-F.col("level"), "n_chars", "source")
    parents = linked.groupBy("rk").agg(F.max_by("source", nearest).alias("parent_turn"), F.countDistinct("source").alias("n_linked"))
    counts = units.groupBy("rk").agg(F.count(F.when(F.expr("level > 0 AND kind = 'p'"), 1)).alias("n_quotes"))
    written = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.expr("level = 0 AND NOT intro"), F.struct("pos", "body")))), lambda x: x["body"]), "\n")
    replies = lines.groupBy("rk").agg(F.regexp_replace(written, r"^\s+|\s+$", "").alias("reply"))
    found = scratch.save(rows.drop("text").join(replies, "rk", "left").join(counts, "rk", "left").join(parents, "rk", "left"), "found")
    pairs = found.filter("parent_turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("parent_turn"))
    pairs = scratch.save(pairs, "pairs")
    threads = _threads(pairs, scratch).join(pairs, ["conv_id", "turn"])
    zero = F.lit(0)
    return found.drop("parent_turn").join(threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.coalesce("reply", F.lit("")).alias("reply"), F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
        "parent_turn", F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("depth", zero).alias("depth"),
    )


def conversations(linked: DataFrame, span: int = 256) -> DataFrame:
    """Conversations without quotations, from the rows of ``link_quotes``: ``conv_id, thread_root, part, messages`` with messages in reply order.

    A message comes after the one it answers.  A part holds ``span`` turns, so that a very long thread is several rows and no task gathers all of it; parts in
    order are the thread.  A thread without a turn is one part.
    """
    message = F.struct("turn", "depth", "parent_turn", "role", "reply")
    part = F.coalesce(F.floor((F.col("turn") - F.col("thread_root")) / span), F.lit(0)).cast("int")
    return linked.groupBy("conv_id", "thread_root", part.alias("part")).agg(F.sort_array(F.collect_list(message)).alias("messages"))
