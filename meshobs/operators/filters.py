"""Filters, paging and keyed merging shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def parse_iatas(iatas: str | None, iata: str | None = None) -> list[str] | None:
    """a comma list of places in upper case; the plural argument wins; None if nothing is named.  ``parse_iatas_col`` does it to a column."""
    found = [p.strip().upper() for p in (iatas or iata or "").split(",")]
    return [p for p in found if p] or None


def parse_iatas_col(text: Column) -> Column:
    """F2 as a column."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def filter_iatas(df: DataFrame, iatas: Sequence[str] | None, *, col: str = "iata") -> DataFrame:
    """no list, or an empty one, keeps all."""
    return df.filter(F.col(col).isin(list(iatas))) if iatas else df


def region_iatas(regions: DataFrame, members: DataFrame, *, region_id: int | None = None, slug: str | None = None) -> DataFrame:
    """the places of a region, in order; the id beats the slug; an unknown region is an error."""
    wanted = regions.filter(F.col("region_id") == region_id) if region_id is not None else regions.filter(F.col("slug") == slug)
    if wanted.isEmpty():
        raise ValueError(f"unknown region {slug if region_id is None else region_id}")
    return members.join(F.broadcast(wanted.select("region_id")), "region_id", "left_semi").select("iata").orderBy("iata")


def filter_region(df: DataFrame, places: DataFrame) -> DataFrame:
    """rows whose place is among a region's."""
    return df.join(places.select("iata").distinct(), "iata", "left_semi")


def filter_allowed(df: DataFrame, airports: DataFrame, *, countries: Sequence[str] = (), continents: Sequence[str] = ()) -> DataFrame:
    """places whose country or continent is allowed; without lists all."""
    if not countries and not continents:
        return df
    allowed = airports.filter(F.col("country").isin(list(countries)) | F.col("continent").isin(list(continents)))
    return df.join(allowed.select("iata"), "iata", "left_semi")


def between(df: DataFrame, col: str, *, since=None, until=None) -> DataFrame:
    """both ends included; None leaves an end open."""
    df = df if since is None else df.filter(F.col(col) >= F.lit(since))
    return df if until is None else df.filter(F.col(col) <= F.lit(until))


def trailing(df: DataFrame, col: str, *, as_of, window: str) -> DataFrame:
    """strictly later than ``as_of`` less ``window``, such as ``24 hours``."""
    return df.filter(F.col(col) > F.lit(as_of) - F.expr(f"INTERVAL {window}"))


def equals(df: DataFrame, **wanted) -> DataFrame:
    """columns equal to values; None means any."""
    for col, value in wanted.items():
        df = df if value is None else df.filter(F.col(col) == value)
    return df


def tristate(df: DataFrame, col: str, flag: bool | None) -> DataFrame:
    """F8: any, true or false."""
    return df if flag is None else df.filter(F.coalesce(F.col(col), F.lit(False)) == flag)


def name_like(df: DataFrame, col: str, term: str | None) -> DataFrame:
    """holds the term in any case; ``%`` and ``_`` in it are wildcards."""
    return df.filter(F.col(col).ilike(f"%{term}%")) if term else df


def place_like(df: DataFrame, col: str, pattern: str | None) -> DataFrame:
    """one place in any case."""
    return df.filter(F.col(col).ilike(pattern)) if pattern else df


def heard_in(df: DataFrame, rows: DataFrame, key: str, iatas: Sequence[str] | None) -> DataFrame:
    """rows of ``df`` that have some row of the same ``key`` in the places."""
    return df.join(filter_iatas(rows, iatas).select(key), key, "left_semi") if iatas else df


def with_status(df: DataFrame, status: str | None, *, as_of) -> DataFrame:
    """derived status ``online`` or ``offline``."""
    return df if status is None else df.filter(X.online_status(F.col("last_status_at"), F.lit(as_of)) == status)


def trace_typed(df: DataFrame, trace_type: str | None) -> DataFrame:
    """the JSON type of a trace payload, asked for in any case."""
    return df if trace_type is None else df.filter(X.json_field(F.col("parsed_payload"), "type") == trace_type.upper())


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def page_desc(df: DataFrame, ts: str, *, cursor=None, limit: int | None = 50, ties: Sequence[str] = ()) -> DataFrame:
    """Newest first, before the cursor; one row more than ``limit`` tells that more follow."""
    df = df if cursor is None else df.filter(F.col(ts) < F.lit(cursor))
    return limited(df.orderBy(F.col(ts).desc(), *ties), None if limit is None else limit + 1)


def page_meta(page: DataFrame, ts: str, *, limit: int) -> tuple[list, bool, int | None]:
    """The items of a page of ``limit + 1`` rows, whether more follow, and the next cursor in ms."""
    rows = page.withColumn("_cursor", X.epoch_ms(F.col(ts))).limit(limit + 1).collect()
    items = rows[:limit]
    return items, len(rows) > limit, items[-1]["_cursor"] if len(rows) > limit and items else None


def page_by_id(df: DataFrame, *, cursor: int | None = None, limit: int | None = 50, desc: bool = True) -> DataFrame:
    """By id, before the cursor going down or after it going up."""
    if cursor is not None:
        df = df.filter(F.col("id") < cursor if desc else F.col("id") > cursor)
    return limited(df.orderBy(F.col("id").desc() if desc else F.col("id").asc()), limit)


def after_id(df: DataFrame, *, after: int, limit: int | None = 100) -> DataFrame:
    """What came after an id, oldest first."""
    return limited(df.filter(F.col("id") > after).orderBy("id"), limit)


def top(df: DataFrame, by: str, *, limit: int | None = 10, ties: Sequence[str] = ()) -> DataFrame:
    """P4."""
    return limited(df.orderBy(F.col(by).desc(), *ties), limit)


#: How a column of the old and the new rows of a key merges.
RULES = {
    "sum": F.sum, "min": F.min, "max": F.max, "or": F.bool_or, "sketch": F.hll_union_agg,
    "first": lambda c: F.min_by(c, "_age"), "last": lambda c: F.max_by(c, "_age"),
    "last_known": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_age"))),
    "first_known": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_age"))),
}


def merge_by_key(existing: DataFrame | None, updates: DataFrame, keys: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """One row per key; ``rules`` names for each other column how old and new values merge.

    ``updates`` has one row per key at most; ``sum``, ``min``, ``max``, ``or`` and ``sketch`` work on both sides, ``first`` keeps the old value,
    ``last`` takes the new one, and the ``known`` forms skip nulls.
    """
    if existing is None:
        return updates.select(*keys, *rules)
    both = existing.select(*keys, *rules, F.lit(0).alias("_age")).unionByName(updates.select(*keys, *rules, F.lit(1).alias("_age")))
    return both.groupBy(*keys).agg(*(RULES[rule](col).alias(col) for col, rule in rules.items()))
