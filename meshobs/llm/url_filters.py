"""URL filters: host rules by the longest suffix, then pattern rules found through their rarest literal.

A pattern rule is text with ``*`` for anything, ``^`` for a separator or an end, ``||`` first for the start of a host label and ``|`` last for the
end of the URL.  Its literal tokens are the runs of letters and digits that have something other than a letter or digit, or an end, on either side in the pattern, so
every URL that matches holds them as whole tokens.  Counting these tokens over all URLs shows which of a rule's
literals is rarest; the rule is filed under that one (a rule without any is tried on every URL).  A URL looks up its own tokens and
runs only the expressions filed there.

Nulls: a null URL, or one without ``://``, has an empty host and path; no host rule fits it, and the
pattern rules see the URL itself (null: empty).  An empty table gives an empty result.  Rows are judged
one by one, so repeated rows, null ids and clashing columns do not matter.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    """A rule for a host, its subdomains and the paths that start with the rule's."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


@dataclass(frozen=True)
class PatternRule:
    """A pattern over the URL with A-Z lower-cased."""

    verdict: str
    pattern: str

    @property
    def regex(self) -> str:
        text, start, end = self.pattern, "", ""
        if text.startswith("||"):
            text, start = text[2:], r"://(?:[a-z0-9-]+\.)*"
        elif text.startswith("^"):
            text, start = text[1:], "(?:^|[^a-z0-9])"
        if text.endswith("|"):
            text, end = text[:-1], "$"
        return start + "".join({"*": ".*", "^": "(?:[^a-z0-9]|$)"}.get(c, re.escape(c)) for c in text) + end

    @property
    def literals(self) -> tuple[str, ...]:
        """Whole tokens of every match: nothing that an edge of the pattern or a ``*`` may continue."""
        bounded = self.pattern.replace("*", "\0")
        return tuple(dict.fromkeys(m[0] for m in re.finditer(r"(?<=[^a-z0-9\0])[a-z0-9]+(?=[^a-z0-9\0])", bounded)))


#: The host rules that the operator's query is given.
HOST_RULES = (
    HostRule("allow", "com/"),
    HostRule("block", "example.com/en/"),
    HostRule("allow", "www.example.com/en/"),
    HostRule("block", "net/es/"),
    HostRule("block", "net/fr/"),
)

#: Pattern rules for what no host rule judges.  Allowing rules are exceptions and win.
PATTERN_RULES = (
    PatternRule("block", "||spam-farm."),
    PatternRule("block", "||cheap-pills."),
    PatternRule("block", "^casino^"),
    PatternRule("block", "^utm_source=feed^"),
    PatternRule("block", "^ref=x&*page="),
    PatternRule("block", "^page=*&ref=x^"),
    PatternRule("allow", "||blog.*/en/*?utm_source="),
    PatternRule("block", "||m.*#top|"),
)


def lowered(url: str) -> str:
    """With A-Z in lower case."""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), url)


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of ``tokens``; the result has one row per literal of the rules at most."""
    low = F.translate("url", string.ascii_uppercase, string.ascii_lowercase)
    held = F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))).alias("token")
    rows = urls.select(held).join(F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")), "token").groupBy("token").count().collect()
    return {t: 0 for t in tokens} | {r["token"]: r["count"] for r in rows}


def index_rules(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> dict[str, list[tuple[str, str]]]:
    """Expressions by their rule's rarest literal, ``""`` without one; ties go to the longer, then to the first in order."""
    index: dict[str, list[tuple[str, str]]] = {}
    for rule in rules:
        rarest = min(rule.literals, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        index.setdefault(rarest, []).append((rule.verdict, rule.regex))
    return index


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = re.search(r"[/?#]", rest)
    host, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    cut = re.search(r"[?#]", rest)
    return lowered(host), rest[: cut.start()] if cut else rest


def filter_urls(
    pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, default: str = "allow"
) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, n_candidates, n_matched`` for every row of ``pages``."""
    urls = pages.select("page_id", "url")
    literals = sorted({t for r in pattern_rules for t in r.literals})
    index = index_rules(pattern_rules, token_counts(urls, literals) if literals else {})
    by_host: dict[str, list[HostRule]] = {}
    for rule in host_rules:
        by_host.setdefault(rule.host, []).append(rule)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = {t: [(v, re.compile(p)) for v, p in found] for t, found in index.items()}
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                labels = host.split(".")
                fits = [r for i in range(len(labels)) for r in by_host.get(".".join(labels[i:]), ()) if host and path.startswith(r.path)]
                low = lowered(url or "")
                found = [f for t in sorted({"", *TOKEN.findall(low)}) for f in filed.get(t, ())]
                hits = [v for v, p in found if p.search(low)]
                best = max(fits, key=lambda r: len(r.rule), default=None)
                own = "allow" if "allow" in hits else "block" if "block" in hits else default
                out.append((host, path, best.rule if best else None, best.verdict if best else own, len(found), len(hits)))
            host, path, rule, verdict, tried, hit = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict)), pa.array(tried, pa.int32()), pa.array(hit, pa.int32())],
                ["page_id", "url", "host", "path", "rule", "verdict", "n_candidates", "n_matched"],
            )

    kinds = f"page_id {urls.schema['page_id'].dataType.simpleString()}, url string, host string, path string, rule string, verdict string, n_candidates int, n_matched int"
    return urls.mapInArrow(judge, kinds)
