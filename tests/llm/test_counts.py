"""Operators 11 to 13: plain Python over whole small tables, odd rows, hot keys, clashing columns."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayer.llm import collocations, quality_rules, queries, trie

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONV = "conv_id long, turn long, role string, text string"
DOC = "doc_id long, text string, lang string, source string"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def clashing(df, names):
    return df.withColumns({n: F.lit("mine") for n in names if n not in df.columns})


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: y[0])] for c, x in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        base, h = c - (abs(c) % 20) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 4
        turns = own[c] if c == base else own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = Counter(x[:-1] for x in members if x)
    leaves, saved = Counter(), Counter()
    for x, m in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += not children[x]
            saved[x[:d]] += (len(m) - 1) * (len(WORD.findall(x[-1][1])) if x else 0)
    return {
        (min(m), len(x), min(members[x[:-1]]) if x else None, len(m), children[x], leaves[x], saved[x], hashlib.sha256(",".join(map(str, sorted(ends[x]))).encode()).hexdigest())
        for x, m in members.items()
    }


def nodes_of(df):
    return {tuple(r) for r in trie.nodes(df).drop("a", "b").collect()}


@data
def test_trie_of_the_table(spark):
    t = pq.read_table(f"{DATA}/conversations.parquet", columns=["conv_id", "turn", "role", "text"])
    got = queries.op11_prefix_trie(spark, DATA).collect()
    assert {tuple(r) for r in got} == brute_trie(list(zip(*t.to_pydict().values()))) and len(got) == len(set(got))


@pytest.mark.parametrize("bits", [1, 16])
def test_trie_of_odd_rows(spark, monkeypatch, bits):
    """Shared openings, a long conversation in many blocks, negative ids, absent bases, turnless conversations, repeats, nulls."""
    monkeypatch.setattr(trie, "BLOCK_BITS", bits)
    rng, rows = random.Random(3), []
    for c in [*range(0, 60), *range(-45, -1, 4), 1001, 1003, 1007, 2**62]:
        rows += [(c, t * 3 - 5, rng.choice(["user", "tool", None]), rng.choice(["a b", "a  b c", "", None, "é x y"])) for t in range(rng.randint(1, 5))]
    rows += [(41, 100 + t, "user", f"w{t % 3}") for t in range(70)]
    rows += [(43, None, "user", "first"), (44, -(2**62), "user", "far"), (None, 1, "user", "nobody"), (1003, 50, "user", "again"), (1003, 50, "user", "again")]
    rows = list(dict.fromkeys(rows[:-2])) + rows[-2:]
    df = clashing(spark.createDataFrame(rows, CONV), ["family", "conv", "depth", "a", "block", "pos", "words", "members", "bit"])
    assert nodes_of(df) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_ones(spark):
    assert nodes_of(spark.createDataFrame([], CONV)) == set()
    assert nodes_of(spark.createDataFrame([(None, 1, "user", "x")], CONV)) == set()
    # 21 takes no turn of an absent base and drops its own first ones.
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 2)
    rows = [(lone, 0, "user", "x"), (lone, 1, "user", "y")]
    assert nodes_of(spark.createDataFrame(rows, CONV)) == brute_trie(rows) == {(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}


def brute_phrases(rows, max_n, least, covered, limit):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, w), a in cands.items():
        inside = any(l2 == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= covered * a for (l2, v), b in cands.items())
        if not inside:
            score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:limit])}


def phrases_of(df, **options):
    return {tuple(r) for r in collocations.phrases(df, **options).collect()}


def test_phrases_of_odd_rows(spark):
    rng = random.Random(5)
    words = ["New", "york", "city", "of", "the", "é", "ß", "x" * 40, "a-b", " ", "😀"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\v"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(t, rng.choice(["en", "en", "en", "de", None, "und", ""])) for t in texts] + [(None, "en"), ("", None), ("new york city", "en"), ("...", "xx")] + [("of the of the of the of the", "en")] * 9
    df = spark.createDataFrame([(i, t, l, "s") for i, (t, l) in enumerate(rows)], DOC)
    df = clashing(df, ["phrase", "f", "size", "k", "first", "rest", "rank", "n"])
    for options in ({"max_n": 4, "least": 6, "covered": 80, "limit": 2000}, {"max_n": 3, "least": 3, "covered": 60, "limit": 7}, {"max_n": 6, "least": 9, "covered": 80, "limit": 50}, {"max_n": 2, "least": 2, "covered": 80, "limit": 9}):
        got = phrases_of(df, **options)
        assert got == brute_phrases(rows, **options) and got
    assert phrases_of(df, max_n=1) == set() == phrases_of(df.limit(0)) == phrases_of(df, least=10**6)


def test_phrases_beyond_a_small_bitmap(spark, monkeypatch):
    """Collisions let phrases through to the exact counts, which stay what they are."""
    rng = random.Random(8)
    rows = [(" ".join(f"w{min(rng.randint(0, 400), rng.randint(0, 400))}" for _ in range(80)), "en") for _ in range(120)]
    df = spark.createDataFrame([(i, t, l, "s") for i, (t, l) in enumerate(rows)], DOC)
    want = brute_phrases(rows, 4, 4, 80, 500)
    monkeypatch.setattr(collocations, "LEAST_BITS", 6)
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    assert phrases_of(df, least=4, limit=500) == want and want


def test_phrase_scores_pass_64_bits(spark):
    row = spark.sql("SELECT cast(9000000000000000000 as bigint) AS a, cast(9000000000000000000 as bigint) AS l, cast(9100000000000000000 as bigint) AS r")
    score = row.selectExpr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) AS s").first()[0]
    assert score == 2_000_000 * 9 * 10**18 // (9 * 10**18 + 91 * 10**17)


@data
@pytest.mark.parametrize("name", ["op12_phrase_collocations", "op13_quality_rules", "op11_prefix_trie"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    found = con.execute(queries.oracle_sql()[name])
    order = [[d[0] for d in found.description].index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def normal(line):
    return tuple(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), w)) for w in WORD.findall(line))


def brute_rules(rows, least, percent, keep):
    texts = defaultdict(set)
    for _, text, _, host in rows:
        texts[host].add(text)
    often = {}
    for host, own in texts.items():
        seen = Counter(x for t in own for x in {normal(y) for y in (t or "").split("\n")} if x)
        often[host] = {x for x, n in seen.items() if n > least and 100 * n > percent * len(own)}
    out, cleaned = [], []
    for i, text, _, host in rows:
        f = figures(text)
        gone = sum(len(normal(x)) for x in (text or "").split("\n") if normal(x) in often[host])
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        out.append((i, *f, gone, failed, not failed and 100 * (f[0] - gone) >= keep * f[0]))
        cleaned.append((i, text if text is None else "\n".join(x for x in text.split("\n") if normal(x) not in often[host])))
    return sorted(out, key=repr), sorted(cleaned, key=repr)


def test_rules_of_odd_rows(spark):
    """Furniture of a hot host, copies, nulls, empty and long texts, repeats under one id, odd white space."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randint(0, 900)}é" for _ in range(n))
    rows = []
    for i in range(160):
        lines = [prose(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        for furniture, share in (("Page 12 of 99", 0.7), ("  subscribe\tNOW ", 0.5), ("© all rights reserved here today " * 9, 0.3), ("", 0.5), ("Page 3 of 4", 0.3)):
            if rng.random() < share:
                lines.insert(rng.randint(0, len(lines)), furniture)
        rows.append((i, "\n".join(lines), "en", rng.choice(["hot", "hot", "hot", "b", None])))
    rows += [(200 + i, prose(40) + "\n" + prose(30), "en", "copies") for i in range(3)]
    rows += [(300, rows[-1][1], "en", "copies")] * 30
    odd = [None, "", " \n\t\n", "a b c a b c a b c\n" * 30, prose(20_000), "#*$ %&|<> x", "one\ntwo\none\n\none \r\none", "x\x85y z", "\n\n", "a b", "😀 ß\n😀 ß"]
    rows += [(None if k == 3 else 400 + k // 2, t, "en", "odd") for k, t in enumerate(odd)]
    df = clashing(spark.createDataFrame(rows, DOC), ["host", "digest", "n_words", "kept", "lines", "gone", "line", "n"])
    for options in ({"least": 10, "percent": 5, "keep": 50}, {"least": 2, "percent": 30, "keep": 90}):
        verdicts, texts = brute_rules(rows, **options)
        assert sorted(map(tuple, quality_rules.judge(df, **options).collect()), key=repr) == verdicts
        options.pop("keep")
        assert sorted(map(tuple, quality_rules.clean(df, **options).collect()), key=repr) == texts
    assert any(v[6] and not v[8] and not v[7] for v in brute_rules(rows, 10, 5, 90)[0])
    assert quality_rules.judge(df.limit(0)).count() == 0 == quality_rules.clean(df.limit(0)).count()


@data
def test_rules_of_the_table(spark):
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "lang", "source"]).to_pydict()
    rows = list(zip(*t.values()))
    verdicts, _ = brute_rules(rows, quality_rules.LEAST, quality_rules.PERCENT, quality_rules.KEEP)
    assert sorted(map(tuple, queries.op13_quality_rules(spark, DATA).collect()), key=repr) == verdicts
