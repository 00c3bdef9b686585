"""Outlier rules, language-model scores, quotes, URL filters and resharding."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from edge import REPEATED, ROWS, frame

from meshobs.llm import ctw_scoring as ctw
from meshobs.llm import flow_reshard as flow
from meshobs.llm import mcd_quality as mcd
from meshobs.llm import url_filters as urls
from meshobs.llm.oracles import URL_FILTERS
from meshobs.llm.quote_linking import conversations, link_quotes
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- quality


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@pytest.mark.parametrize("rows", [ROWS, REPEATED, []])
def test_counts_and_base_rules(spark, rows):
    got = mcd.mcd_quality(frame(spark, rows)).collect()
    want = []
    for doc, text, *_ in rows:
        n = brute_counts(text)
        want.append((doc, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == sorted(want, key=repr)
    assert not any(r.kept for r in got if r.base_failed)


def metric(x, centre, covariance):
    off = x / 1024 - centre
    return np.einsum("ni,ij,nj->n", off, np.linalg.inv(covariance), off)


def brute_mcd(x, coverage):
    """Centre and widened covariance of one group of grid vectors: three starts, two steps each, then the best until it settles."""
    floor = np.array([0.06, 0.05, 0.08, 0.06, 0.2, 0.2])
    middle = np.median(x, axis=0)
    deviation = np.median(abs(x - middle), axis=0)
    z = (x - middle) / (1.4826 * deviation + floor * 1024)
    length = np.linalg.norm(z, axis=1, keepdims=True)
    scale = np.sqrt((1.4826 * deviation / 1024) ** 2 + floor**2)

    def step(centre, covariance):
        d = np.floor(np.log1p(np.maximum(0, metric(x, centre, covariance))) * 512)
        near = x[d <= np.sort(d)[math.ceil(coverage * len(x)) - 1]]
        return near.mean(axis=0) / 1024, np.cov(near.T, bias=True) / 1024**2 + np.diag(floor**2)

    found = []
    for k, v in enumerate([None, np.tanh(z), np.divide(z, length, out=np.zeros_like(z), where=length > 0)]):
        together = np.eye(6)
        if k:
            whole = np.floor(abs(v) * 1024 + 0.5) * np.sign(v)
            second = whole.T @ whole
            size = np.sqrt(np.maximum(np.diag(second), 1e-9))
            together = 0.99 * second / np.outer(size, size) + 0.01 * np.eye(6)
        centre, covariance = middle / 1024, together * np.outer(scale, scale)
        for _ in range(2):
            centre, covariance = step(centre, covariance)
        found.append((np.linalg.slogdet(covariance)[1], k, centre, covariance))
    _, _, centre, covariance = min(found, key=lambda f: (round(f[0], 9), f[1]))
    for _ in range(40):
        further = step(centre, covariance)
        if not np.linalg.slogdet(covariance)[1] - np.linalg.slogdet(further[1])[1] > 1e-4:
            break
        centre, covariance = further
    d = np.floor(np.log1p(metric(x, centre, covariance)) * 512)
    return centre, covariance * max(1.0, np.expm1((np.median(d) + 0.5) / 512) / mcd.chi_square(6, 0.0))


def brute_verdicts(rows):
    """``(distance, kept)`` by ``doc_id`` of the rows that pass the base rules: a source's estimate leans on its language's, and that on the one of all rows."""
    texts = {r.doc_id: r for r in rows}
    ids = [d for d, r in sorted(texts.items()) if (n := brute_counts(r.text))[0] >= 50 and 100 * n[4] <= 50 * n[0]]

    def vector(doc):
        n_words, chars, symbols, dup, repeat, capitals, marks, lines = mcd.text_counts(texts[doc].text.encode())
        share = lambda a, b: math.asin(math.sqrt(min(1.0, a / max(b, 1))))
        values = [math.log(chars / n_words), share(symbols, chars), share(capitals, chars), share(marks, chars), share(dup, lines), share(repeat, n_words)]
        return [math.floor(v * 1024 + 0.5) for v in values]

    x = np.array([vector(d) for d in ids], float)
    levels = [lambda d: (texts[d].lang, texts[d].source), lambda d: texts[d].lang, lambda d: ""]
    keys = [[level(d) for d in ids] for level in levels]
    known = {key: (sum(k == key for k in own), *brute_mcd(x[[k == key for k in own]], 0.75)) for own in keys for key in set(own)}
    found = {}
    for at, d in enumerate(ids):
        _, centre, covariance = known[keys[2][at]]
        for own in (keys[1], keys[0]):
            n, c, v = known[own[at]]
            centre, covariance = (n * c + 100 * centre) / (n + 100), (n * v + 100 * covariance) / (n + 100)
        distance = metric(x[at : at + 1], centre, covariance)[0]
        found[d] = distance, distance <= mcd.chi_square(6, 4.0)
    return found


def test_estimates_against_numpy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_verdicts(docs.collect())
    got = {r.doc_id: r for r in mcd.mcd_quality(docs).collect()}
    assert {d for d, r in got.items() if not r.base_failed} == set(want)
    for d, (distance, kept) in want.items():
        assert got[d].distance == pytest.approx(distance, rel=1e-5) and got[d].kept == kept


def test_null_languages_and_sources_are_values_of_their_own(spark):
    drawn = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"source": F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise("a"), "lang": F.when(F.col("doc_id") % 3 > 0, F.lit("en"))})
    want = brute_verdicts(drawn.collect())
    got = {r.doc_id: r for r in mcd.mcd_quality(drawn).collect()}
    assert len({(r.lang, r.source) for r in drawn.collect()}) == 4
    for d, (distance, kept) in want.items():
        assert got[d].distance == pytest.approx(distance, rel=1e-5) and got[d].kept == kept


def test_least_determinant_withstands_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (400, 6)), rng.normal(6, 0.3, (100, 6))]) * 1024
    df = spark.createDataFrame([("g", *map(int, row)) for row in np.round(x)], "key string, " + ", ".join(f"x{i} long" for i in range(6)))
    found = mcd.estimates(df, 1, mcd.Scratch(spark, "t"), 0.75).first()
    assert np.abs(found.centre).max() < 0.3 and found.n_rows == 500


@pytest.mark.parametrize("limit", [20_000, 0])
def test_estimates_broadcast_or_salted(spark, monkeypatch, limit):
    monkeypatch.setattr(mcd, "BROADCAST_KEYS", limit)
    got = mcd.mcd_quality(spark.read.parquet(f"{SF}/documents.parquet")).agg(F.sum("distance").alias("d"), F.count("kept").alias("n")).first()
    monkeypatch.undo()
    want = mcd.mcd_quality(spark.read.parquet(f"{SF}/documents.parquet")).agg(F.sum("distance").alias("d"), F.count("kept").alias("n")).first()
    assert got.n == want.n and got.d == pytest.approx(want.d)


def test_verdict_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in mcd.mcd_quality(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[r.doc_id].kept for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    bad = [got[r.doc_id].kept for r in labels if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_accepted_keeps_columns(spark):
    df = frame(spark, REPEATED)
    assert mcd.accepted(df, df.columns).columns == df.columns


# -- language model


def brute_ctw(docs, depth):
    """Sequential estimates of the same trees, one dictionary per node, without grouping or sharing."""
    texts = [(d, lang, (t or "").encode().lower().split(), d is not None and zlib.crc32(str(d).encode()) % 10 == 0) for d, t, lang in docs]
    train = [(lang, w) for _, lang, w, held in texts if not held]
    langs = [lang for lang, _ in Counter(lang for _, lang, _, _ in texts if lang is not None).most_common(ctw.CLASSES - 1)]
    classes = sorted(langs)
    of = lambda lang: classes.index(lang) if lang in classes else len(classes)
    many, counts = len(classes) + 1, {}

    def bits(words):
        for word in [*(w + b" " for w in words), bytes([ctw.END])]:
            data = b" " * depth + word
            for at in range(depth, len(data)):
                for k in range(8):
                    yield data[at - depth : at], 1 << k | data[at] >> (8 - k), data[at] >> (7 - k) & 1

    def nodes(context, prefix, c):
        return [(context[depth - d :], prefix) for d in range(depth + 1)] + [(context, prefix, c)]

    for lang, words in train:
        for context, prefix, bit in bits(words):
            for node in nodes(context, prefix, of(lang)):
                counts.setdefault(node, [0, 0])[bit] += 1
    kt = lambda n: ctw.log_kt(np.array([float(n[0])]), np.array([float(n[1])]))[0]
    children = {}
    for node in counts:
        parent = node[:2] if len(node) == 3 else (node[0][1:], node[1]) if node[0] else None
        children.setdefault(parent, []).append(node)
    weighted, share = {}, {}

    def weigh(node):
        own = kt(counts[node])
        if len(node) == 3:
            weighted[node] = own
            return own
        both = np.logaddexp(own, sum(weigh(x) for x in children.get(node, []))) - np.log(2)
        weighted[node], share[node] = both, np.exp(own - np.log(2) - both)
        return both

    for node in [n for n in counts if n[0] == b"" and len(n) == 2]:
        weigh(node)
    prior = np.array([sum(of(lang) == c for lang, _ in train) for c in range(many)]) / max(1, len(train))
    out = []
    for _, _, words, _ in texts:
        under = []
        for c in range(many):
            total = 0.0
            for context, prefix, bit in bits(words):
                chance = None
                for node in reversed(nodes(context, prefix, c)):
                    n = counts.get(node, [0, 0])
                    own = (n[bit] + 0.5) / (sum(n) + 1)
                    chance = own if chance is None else share.get(node, 0.5) * own + (1 - share.get(node, 0.5)) * chance
                total += np.log10(chance)
            under.append(total + (np.log10(prior[c]) if prior[c] else -300))
        out.append(max(under) + np.log10(sum(10 ** (u - max(under)) for u in under)))
    return out


SMALL = [(d, (t or "")[:200] if t is not None else None, lang) for d, t, lang, *_ in REPEATED] + [(k, f"die katze {k} sitzt auf der matte", "de") for k in range(20, 40)] + [(k, f"the cat {k} sat on the mat", "en") for k in range(40, 60)]


@pytest.mark.parametrize("depth, limit, block", [(3, 10**6, 1 << 20), (3, 0, 200), (6, 10**6, 500)])
def test_ctw_against_brute_force(spark, depth, limit, block):
    df = spark.createDataFrame(SMALL, "doc_id long, text string, lang string").withColumn("words", F.lit("clash"))
    got = ctw.ctw_scores(df, depth=depth, broadcast=limit, block_bytes=block).collect()
    want = [(d, round(s, 3)) for (d, *_), s in zip(SMALL, brute_ctw(SMALL, depth), strict=True)]
    assert len(got) == len(want)
    for (d, s), (e, u) in zip(sorted(((r.doc_id, r.score) for r in got), key=repr), sorted(want, key=repr), strict=True):
        assert d == e and abs(s - u) < 0.01
    known, n, ends = Counter(), 0, 0
    for d, t, _ in SMALL:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            words = (t or "").encode().lower().split()
            known.update(words)
            n, ends = n + len(words) + 1, ends + 1
    rate = n + 0.1 * (len(known) + 2)
    text = {d: t for d, t, _ in SMALL}
    for r in got:
        words = (text[r.doc_id] or "").encode().lower().split() if r.doc_id is not None else None
        assert r.train_tokens == n and (words is None or (r.n_tokens, r.n_known) == (len(words) + 1, 1 + sum(known[w] > 0 for w in words)))
        if words is not None:
            assert r.base_score == pytest.approx(sum(math.log10((known[w] + 0.1) / rate) for w in words) + math.log10((ends + 0.1) / rate))


def test_ctw_of_nothing(spark):
    assert ctw.ctw_scores(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_ctw_beats_the_base_on_held_out_texts(spark):
    got = ctw.ctw_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 2.0, 7.5, 100.0, 12345.5])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


# -- quotes


def test_quotes(spark):
    first = "Hello there, this is the first message.\nIt has two lines and more."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", "On Monday, user wrote:\n> Hello there, this is the  FIRST message.\n> It has two lines and more.\n\nI reply to that with my words here."),
        (1, 2, "user", ">> Hello there, this is the first message.\n>> It has two lines and more.\n> I reply to that with my words here.\nThird message has this text."),
        (1, 3, "assistant", "> It has two lines and more.\nanother branch of the talk"), (2, 0, "user", "> Hello there, this is the first message.\nelsewhere"), (None, 0, None, None), (2, None, "x", "> Hello there"),
        (1, 2, "user", "repeated turn"), (3, 0, "user", ""), (3, 1, "user", "> \n>\nempty quotes"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("rk", F.lit("clash"))
    got = {(r.conv_id, r.turn, r.reply): (r.n_quotes, r.n_linked, r.parent_turn, r.thread_root, r.depth) for r in link_quotes(df).collect()}
    assert got == {
        (1, 0, first): (0, 0, None, 0, 0), (1, 1, "I reply to that with my words here."): (1, 1, 0, 0, 1), (1, 2, "Third message has this text."): (2, 2, 1, 0, 2),
        (1, 3, "another branch of the talk"): (1, 1, 0, 0, 1), (2, 0, "elsewhere"): (1, 0, None, 0, 0), (None, 0, ""): (0, 0, None, 0, 0), (2, None, ""): (1, 0, None, None, 0),
        (1, 2, "repeated turn"): (0, 0, 1, 0, 2), (3, 0, ""): (0, 0, None, 0, 0), (3, 1, "empty quotes"): (0, 0, None, 1, 0),
    }


def test_a_long_chain_and_derived_quotes(spark):
    """Each turn of the given conversations quotes the one before."""
    from pyspark.sql import Window

    talk = spark.read.parquet(f"{SF}/conversations.parquet")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    quoted = F.when(before.isNotNull(), F.concat(F.lit("> "), F.regexp_replace(before, "\n", "\n> "), F.lit("\n\n"))).otherwise("")
    got = link_quotes(talk.withColumn("text", F.concat(quoted, "text"))).collect()
    plain = {(r.conv_id, r.turn): r.text for r in talk.collect()}
    for r in got:
        assert r.reply.split() == plain[r.conv_id, r.turn].split() and r.thread_root == 0 and r.depth == r.turn and r.parent_turn == (r.turn - 1 if r.turn else None)
    assert link_quotes(talk.limit(0)).count() == 0


def brute_quotes(rows):
    """``(conv, turn, reply, n_quotes, n_linked, parent, root, depth)`` of each message, one at a time."""
    units, replies = [], []
    for conv, turn, text in rows:
        lines = []
        for line in re.split(r"\r?\n", text or ""):
            prefix = re.match(r"(?:[ \t]*>)*", line)[0]
            lines.append((prefix.count(">"), line[len(prefix) :]))
        own, block, paragraph, last, reply = {}, 0, 0, None, []
        for pos, (level, body) in enumerate(lines):
            norm = re.sub(r"[ \t\n\x0b\f\r]+", " ", body).lower().strip(" ")
            block += level != last
            paragraph += level != last or norm == ""
            last = level
            if level == 0 and re.search(r"^(on|am|le|el)\b.*\b(wrote|schrieb)\b.*:$", body.strip(), re.I) and pos + 1 < len(lines) and lines[pos + 1][0] > 0:
                continue
            if level == 0:
                reply.append(body.rstrip(" "))
            if norm:
                for unit in [("b", block), ("p", paragraph), ("l", pos), *([("m", 0)] if level == 0 else [])]:
                    own.setdefault((level, *unit), []).append(norm)
        units.append({k: " ".join(v) for k, v in own.items()})
        replies.append("\n".join(reply).strip())
    first = {}
    for (conv, turn, _), own in zip(rows, units, strict=True):
        for (level, *_), text in own.items():
            if level == 0:
                first[conv, text] = min(turn, first.get((conv, text), turn))
    parent = {}
    out = []
    for (conv, turn, _), own, reply in zip(rows, units, replies, strict=True):
        hits = [(-level, len(text), first[conv, text]) for (level, kind, _), text in own.items() if level and (kind != "l" or len(text) >= 20) and first.get((conv, text), turn) < turn]
        parent[conv, turn] = max(hits)[2] if hits else None
        out.append([conv, turn, reply, sum(1 for level, kind, _ in own if level and kind == "p"), len({h[2] for h in hits}), parent[conv, turn]])
    for row in out:
        root, depth = row[1], 0
        while parent[row[0], root] is not None:
            root, depth = parent[row[0], root], depth + 1
        row += [root, depth]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotes_against_brute_force(spark, seed):
    """Messages that quote one another, whole or in part, nested, with attributions, changed case and blanks."""
    rng = np.random.default_rng(seed)
    words = [f"word{k}" for k in range(40)]
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(int(rng.integers(1, 12))):
            lines = []
            for _ in range(int(rng.integers(0, 3))):
                if texts and rng.random() < 0.8:
                    source = texts[int(rng.integers(len(texts)))].split("\n")
                    at = int(rng.integers(len(source)))
                    cut = source[at : at + int(rng.integers(1, 5))]
                    lines += ["On Monday, somebody wrote:"] * int(rng.random() < 0.4) + [f"{rng.choice(['>', '> ', ' >', '>> '])}{x.upper() if rng.random() < 0.2 else x}" for x in cut]
                lines += [" ".join(rng.choice(words, int(rng.integers(1, 9)))) + "  " * int(rng.random() < 0.2) for _ in range(int(rng.integers(0, 3)))] + [""] * int(rng.random() < 0.5)
            texts.append("\n".join(lines))
            rows.append((conv, turn, texts[-1]))
    df = spark.createDataFrame([(c, k, "user", t) for c, k, t in rows], "conv_id long, turn int, role string, text string")
    linked = link_quotes(df)
    got = sorted((r.conv_id, r.turn, r.reply, r.n_quotes, r.n_linked, r.parent_turn, r.thread_root, r.depth) for r in linked.collect())
    want = sorted(map(tuple, brute_quotes(rows)))
    assert got == want and sum(w[5] is not None for w in want) > 5
    threads = {(r.conv_id, r.thread_root): [m.turn for m in r.messages] for r in conversations(linked).collect()}
    assert sorted((c, k) for (c, _), turns in threads.items() for k in turns) == sorted((c, k) for c, k, _ in rows) and all(t == sorted(t) for t in threads.values())
    assert {r.part for r in conversations(linked, span=3).collect()} >= {0, 1}


# -- URLs


def test_urls(spark):
    cases = [
        (1, "http://Www.Example.com/en/x?y"), (2, "https://a.example.com/en/"), (3, "https://example.com"), (4, None), (5, "no scheme spam-farm"), (6, "http://b.net/es/1"), (7, "http://x.com:80/en/"), (8, "http://notexample.com/en/a"),
        (9, "ftp://q.org/p?page=2&ref=x"), (10, "http://blog.a.org/en/1?utm_source=feed"), (11, "http://m.q.org/en/5#top"), (12, ""), (13, "http://a.b/c://d/e"), (14, "http://spam-farm.example.org/en/1"), (1, "http://Www.Example.com/en/x?y"), (None, "http://net/fr/"),
        (15, "http://Ünï.com/a?b://c"), (16, "http://x.org/" + "casino-" * 3000),
    ]
    df = spark.createDataFrame(cases, "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit("clash")})
    got = [tuple(r)[:1] + tuple(r)[2:6] for r in urls.filter_urls(df).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", cases)
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(URL_FILTERS).fetchall()))
    by = {g[0]: g for g in got}
    assert by[1][3:] == ("www.example.com/en/", "allow") and by[2][3:] == ("example.com/en/", "block") and by[6][4] == "block" and by[8][3] == "com/" and by[14][4] == "block" and by[10][4] == "allow"
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_rules_are_filed_under_the_rarest_literal():
    rules = (urls.PatternRule("block", "/common/*.rare."), urls.PatternRule("block", "^common^"), urls.PatternRule("block", "loose*end"))
    assert [r.literals for r in rules] == [("common", "rare"), ("common",), ()]
    index = urls.index_rules(rules, {"common": 10, "rare": 1})
    assert {t: len(found) for t, found in index.items()} == {"rare": 1, "common": 1, "": 1}


def test_thousands_of_rules_against_trying_each(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcde"), rng.integers(1, 4)))
    shapes = ("||{0}.", "/{0}/*{1}|", "^{0}={1}^", "{0}*{1}", "^{0}^*/{1}.", "||{0}-{1}.*?{0}=", "{0}|")
    rules = tuple(urls.PatternRule(str(rng.choice(["allow", "block"], p=[0.1, 0.9])), shapes[k % len(shapes)].format(word(), word())) for k in range(3000))
    pages = [(k, f"http://{word()}.{word()}-{word()}.{word()}/{word()}/{word()}.{word()}?{word()}={word()}") for k in range(300)]
    got = {r.page_id: (r.verdict, r.n_matched) for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), (), rules).collect()}
    compiled = [(r.verdict, re.compile(r.regex)) for r in rules]
    for k, url in pages:
        hits = [v for v, p in compiled if p.search(url)]
        assert got[k] == ("allow" if "allow" in hits or not hits else "block", len(hits))


# -- resharding


def test_flow_is_cheapest():
    old, capacity = {0: 50, 1: 10, 5: 30}, [30, 30, 30]
    moved = flow.transfers(old, capacity)
    assert sum(moved.values()) == 90 and sum(f for (s, j), f in moved.items() if s != j) == 20 + 30
    for j, c in enumerate(capacity):
        assert sum(f for (_, k), f in moved.items() if k == j) == c


@pytest.mark.parametrize("rows", [ROWS, REPEATED, []])
def test_reshard(spark, rows):
    df = frame(spark, rows)
    got = flow.reshard(df, F.when(F.col("source") == "a", 0).otherwise(1), 3).collect()
    want = [(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_reshard_evens_out_and_rewrites(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(4))
    placed = flow.reshard(docs, old, 5).cache()
    sizes = Counter()
    for r in placed.collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 5 and max(sizes.values()) < 1.01 * min(sizes.values())
    before = Counter()
    for r in placed.collect():
        before[r.old_shard] += r["size"]
    least = sum(max(0, n - sum(sizes.values()) / 5) for n in before.values())
    assert sum(r["size"] for r in placed.collect() if r.shard != r.old_shard) < 1.02 * least
    path = str(tmp_path / "shards")
    written = flow.rewrite_affected(docs, placed, path)
    assert spark.read.parquet(path).filter(F.col("shard").isin(written)).count() == sum(1 for r in placed.collect() if r.shard in written)


@pytest.mark.parametrize("n_shards", [5, 1, 30])
def test_rewrite_keeps_every_row_once(spark, tmp_path, n_shards):
    more = [(None, f"no id {k % 7}", "en", "abcdefgh"[k % 8], k % 9) for k in range(60)] + [(k % 5, f"text {k % 11}", "de", "abcdefgh"[k % 3], k % 4) for k in range(60)]
    docs = frame(spark, REPEATED + more)
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(24))
    path = str(tmp_path / "shards")
    docs.withColumn("shard", old.cast("int")).withColumn("slot", F.lit(0).cast("long")).write.partitionBy("shard").parquet(path)
    placed = flow.reshard(docs, old, n_shards)
    flow.rewrite_affected(docs, placed, path)
    got = spark.read.parquet(path)
    of = lambda df: Counter(tuple(r) for r in df.select(docs.columns).collect())
    assert of(got) == of(docs)
    assert Counter((r.doc_id, r.shard) for r in got.collect()) == Counter((r.doc_id, r.shard) for r in placed.collect())
    assert {r.shard for r in got.collect()} <= set(range(n_shards))


def test_many_copies_of_one_row_spread_like_others(spark, tmp_path):
    docs = spark.range(20_000).select(F.when(F.col("id") < 12_000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 12_000, "same text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source"))
    placed = flow.reshard(docs, F.lit(3), 24)
    sizes = [r["n"] for r in placed.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.1 * sum(sizes) / 24 and min(sizes) > 0.9 * sum(sizes) / 24
    path = str(tmp_path / "shards")
    docs.withColumns({"shard": F.lit(3), "slot": F.lit(0).cast("long")}).write.partitionBy("shard").parquet(path)
    flow.rewrite_affected(docs, placed, path)
    got = spark.read.parquet(path)
    of = lambda df, *c: Counter(tuple(r) for r in df.select(*c).collect())
    assert of(got, "doc_id", "text") == of(docs, "doc_id", "text") and of(got, "doc_id", "shard", "slot") == of(placed, "doc_id", "shard", "slot")
