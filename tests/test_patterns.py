"""Patterns before and during the scan: literals, linear forms, many criteria in one pass."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from assayer.functions import flags, patterns
from assayer.sources.documents import TAXONOMY


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"[a-z]+@[a-z]+", {"@"}), (r"licensed under [a-z ]+", {"licensed under "}), (r"(?:token|pass) = x{2,}", {"token", "pass"}), (r"(?:to|pa)  = x", {"  = x"}), (r"(?:abc|bcd)?z", {"z"}), (r"(kill|maim)s?", {"kill", "maim"}),
        (r"a*b?", set()), (r"(?:abc|x*)", set()), (r"(?:Ab){2}c", {"ab"}), (r"é+", set()), (r"(unclosed", set()), (r"x(?!never)y", {"x"}), (r"\bword\b", {"word"}),
    ],
)
def test_required(pattern, want):
    assert patterns.required(pattern) == want


def test_required_never_misses():
    rng = random.Random(1)
    for _ in range(3000):
        atom = lambda: rng.choice(["a", "b", "[ab]", "(?:ab|c)", "(?:a|bc)?", "c{2}", ".", "b*", "(?:ca)+"])
        p = "".join(atom() for _ in range(rng.randint(1, 4)))
        need, text = patterns.required(p), "".join(rng.choice("abcABC") for _ in range(12))
        for m in re.finditer(p, text, re.IGNORECASE):
            assert not need or any(n in m[0].lower() for n in need)
        assert not (m := re.search(p, "")) or patterns.may_be_empty(p)


def test_linear_forms_match_the_same(spark):
    """Found one after the other too, where a match ends within a run of the leading class."""
    given = [r"[a-z0-9._-]+@[a-z0-9-]+\.[a-z0-9.-]*[a-z0-9]", r"[ab]+!x", r"\w+ \w", r"[^ ]+ b", r"[a-z]+a", r"[ab]+(?:c|d)", r"\d+\.\d"]
    assert [patterns.linear(p) == p for p in given] == [False, False, False, False, True, True, False]
    rng = random.Random(7)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for alphabet in ("ab!x", "a@b._-c", "a b", "1.2a", "AbB! x@") for _ in range(120)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in given:
        own, lin = ([r[0] for r in rows.select(F.regexp_extract_all("t", F.lit("(?i)" + q), F.lit(0))).collect()] for q in (p, patterns.linear(p)))
        assert own == lin == [[m[0] for m in re.finditer(p, t, re.IGNORECASE | re.ASCII)] for t in texts]


def test_long_runs_take_little_time(spark):
    rows = spark.createDataFrame([("a" * 1_000_000 + " x @",), ("b" * 1_000_000 + " !! ",), ("a" * 1_000_000 + "@b.cd",)], "t string").cache()
    rows.count()
    scan = lambda: [[f["type"] for f in r[0]] for r in rows.select(flags.flags(F.col("t"), TAXONOMY)).collect()]
    scan()
    began = time.time()
    assert scan() == [[], [], ["contact_detail"]]
    assert time.time() - began < 3
    rows.unpersist()


def plain(text, taxonomy):
    out = []
    for f in taxonomy["flags"]:
        ids = [c["id"] for c in f["criteria"] if any(m[0] and not any(re.search(u, m[0], re.IGNORECASE) for u in c["unless"]) for m in re.finditer(c["pattern"], text, re.IGNORECASE | re.ASCII))]
        if ids:
            out.append((f["type"], "+".join(ids)))
    return out


@pytest.fixture(scope="module")
def many():
    """200 criteria: overlapping literals, ones that start others, alternatives, exemptions, patterns without a literal or of nothing."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))) for _ in range(150)]
    made = [f"{w}{rng.choice(['', ' ?[a-c]+', '[de]', '!*'])}" for w in words] + [f"(?:{rng.choice(words)}|{rng.choice(words)})x" for _ in range(40)] + ["[0-9]{3}", "[a-c]*", "z?", r"[xy]+@b", "é", r"[a-e]+!!", "", "(?:ab)?", r"\.\.", "q{2,}"]
    criteria = [{"id": f"c{i}", "pattern": p, "unless": ["abc"] if i % 7 == 0 else []} for i, p in enumerate(made)]
    return {"taxonomyVersion": "m", "status": "current", "flags": [{"type": f"t{k}", "severity": 1, "criteria": criteria[k::20]} for k in range(20)]}


def test_many_criteria(spark, many):
    rng = random.Random(13)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in ("abcde", "abcdeABCDE ", "abcxy@!. ", "0123é", "q xZ") for _ in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[(f["type"], f["basis"].partition(":")[2]) for f in r[0]] for r in rows.select(flags.flags(F.col("t"), many)).collect()]
    assert got == [plain(t, many) for t in texts]


def test_many_criteria_cost_about_one_pass(spark):
    rng = random.Random(17)
    line = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(20_000))
    rows = spark.createDataFrame([(line,)] * 64, "t string").repartition(4).cache()
    rows.count()

    def took(n):
        taxonomy = {"taxonomyVersion": "m", "status": "current", "flags": [{"type": f"t{i}", "severity": 1, "criteria": [{"id": "c", "pattern": f"qz{i:03d}[a-z]+ [a-z]+", "unless": []}]} for i in range(n)]}
        made, seen = rows.select(F.sum(F.size(flags.flags(F.col("t"), taxonomy)))), []
        for _ in range(3):
            began = time.time()
            made.collect()
            seen.append(time.time() - began)
        return min(seen)

    assert took(200) < 4 * took(20) + 1
    rows.unpersist()
