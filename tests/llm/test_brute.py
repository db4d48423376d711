"""Queries that SQL can't express, against plain Python over whole small tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from assayer.llm import bpe, merkle, perplexity, pii, queries, substring, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(sorted(zip(t["doc_id"], t["text"])))


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    passes = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    kinds = list(pii.PLAIN)
    found = [(m.start(), kinds.index(k), m.end()) for k, p in pii.PLAIN.items() for m in re.finditer(p, text) if passes[k](m[0])]
    return [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found)]


def test_pii_base(spark, texts):
    got = {r["doc_id"]: r for r in queries.op2_pii(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}
        spans = [x.split(":") for x in got[i]["spans"].split(",") if x]
        assert got[i]["personal"] == bool(spans) and got[i]["n_term"] == sum(k == "term" for k, _, _ in spans)
        if not got[i]["n_term"]:
            clean, at = "", 0
            for k, s, e in ((k, int(s), int(e)) for k, s, e in spans):
                if s >= at:
                    clean, at = clean + t[at:s] + f"[{k.upper()}]", e
            assert got[i]["sanitised_sha256"] == hashlib.sha256((clean + t[at:]).encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 20_000])
def test_pii_hard_texts(spark, size):
    hard = [
        "a@b.c_d@e.f x@y..z é@é.com a.b@c-d.e-f.gh, A%+-@b.c@d.e.f", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111x 4111-1111-1111-1111-1 5 4111  1111 4111111111111111",
        "+1 (555) 123-4567 +12345 ++1234567890 +1234567890123456", "@" * size, "1" * size, "1 " * size, "a" * size + "@", ("a." * size) + "@b", "x@" + "a." * size + "b", "+" * size, "+1" + "-" * size + "1", "😀 4111111111111111 é@a.b c@d.e",
    ]
    rows = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    got = {r["doc_id"]: r["base"] for r in pii.find(rows).collect()}
    assert got == {i: ",".join(base(t)) for i, t in enumerate(hard)}


def test_pii_terms(spark):
    """Terms that stand with a repeated entity only are added; the formula is replayed over all documents."""
    docs = [(i, f"common words in text {'abcdefghijklmnopqrstuvwxyz'[i % 26] * 3} number {i % 7}") for i in range(200)]
    docs += [(1000, "zebrafish likes ann@x.example common words"), (1001, "mail ann@x.example of zebrafish here common"), (1002, "bob@y.example and ann only here"), (1003, "nothing zebrafishy"), (1004, "zebrafish")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    words = {i: set(re.findall(r"[^\W\d_]{3,}", re.sub(pii.PLAIN["email"], " ", t.lower()))) for i, t in docs}
    n, held = len(docs), {1000, 1001}
    flagged = set()
    for w in set().union(*words.values()):
        with_w = {i for i in words if w in words[i]}
        met = len(with_w & held)
        if met >= 2 and math.log(n * met / (len(held) * len(with_w))) / math.log(n / len(held)) >= pii.DISCLOSURE:
            flagged.add(w)
    assert flagged == {"zebrafish"}
    assert got[1000]["spans"] == "term:0:9,email:16:29" and got[1001]["n_term"] == 1 and got[1002]["spans"] == "email:0:13" and got[1004]["spans"] == ""
    assert got[1000]["sanitised"] == "[TERM] likes [EMAIL] common words"


def test_pii_terms_of_unique_entities(spark):
    """On whole tables, where nearly every entity stands in one text, the smoothed shares are replayed."""
    tables = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    entities, kinds, words = defaultdict(set), defaultdict(set), {}
    for t in set(tables["text"]):
        words[t] = set(re.findall(r"[^\W\d_]{3,}", re.sub(pii.PLAIN["email"], " ", t.lower())))
        for kind, s, e in (x.split(":") for x in base(t)):
            value = t[int(s) : int(e)]
            entities[kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()].add(t)
            kinds[kind].add(t)
    stands = defaultdict(int)
    for w in words.values():
        for x in w:
            stands[x] += 1
    want = defaultdict(set)
    for (kind, _), at in entities.items():
        if len(at) == 1:
            (t,) = at
            for w in words[t]:
                backed = sum(w in words[o] for o in kinds[kind] - at) / max(1, len(kinds[kind] - at))
                p = (1 + pii.BACKING * backed) / (1 + pii.BACKING)
                if stands[w] <= 20 and math.log(len(words) * p / stands[w]) / math.log(len(words)) >= pii.DISCLOSURE:
                    want[t].add(w)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    found = defaultdict(set)
    for i, t in zip(tables["doc_id"], tables["text"]):
        for kind, s, e in (x.split(":") for x in got[i].split(",") if x):
            if kind == "term":
                found[t].add(t[int(s) : int(e)].lower())
    assert len(want) > 20 and all(want[t] <= found[t] for t in want) and set(found) <= {t for at in kinds.values() for t in at}
    shared = {t for at in entities.values() if len(at) > 1 for t in at}
    assert all(found[t] == want[t] for t in want if t not in shared)


def test_bpe_is_the_library(spark, texts):
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in queries.op4_byte_bpe(spark, DATA).collect()}
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert bpe.encode_text(enc, t, 100) == ids


@pytest.mark.parametrize("blank", [" ", "\t", "\n"])
@pytest.mark.parametrize("around", [("", ""), ("some text", ""), ("", "text"), ("a.", " b c"), ("x ", "\ty")])
def test_bpe_long_blanks(blank, around):
    """A run of white space is one match but for its last character; the library cannot take two million itself."""
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    text = around[0] + blank * 3000 + around[1]
    assert bpe.encode_text(enc, text, 100) == enc.encode_ordinary(text)
    text = around[0] + blank * 2_000_000 + around[1]
    ids = bpe.encode_text(enc, text)
    assert enc.decode_bytes(ids) == text.encode()
    # Whatever the run's tokens are, they take it up to its last character.
    tail = bpe.encode_text(enc, blank * 2 + around[1])
    assert len(ids) > 100_000 and (not around[1] or ids[-2:] == tail[-2:])


def test_toxicity_scores(spark, texts):
    """Cumulative-link scores of every document, word by word, from the fitted numbers."""
    import pyarrow as pa

    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    buckets, weights, cuts = toxicity.train(docs, toxicity.grades_of(labels))
    weight = dict(zip(buckets.tolist(), weights.tolist()))
    worth = {}
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, DATA).collect()}
    assert got.keys() == texts.keys() and (weights > 0).any() and (weights < 0).any() and list(cuts) == sorted(cuts)
    for i, t in texts.items():
        counts = defaultdict(int)
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower()):
            counts[w] += 1
        eta = 0.0
        for w, n in counts.items():
            if w not in worth:
                own = toxicity._distinct_words(pa.array([w.decode("latin-1").encode("latin-1").decode()]))[2][0]
                worth[w] = sum(weight.get(int(b), 0.0) for b in own)
            eta += worth[w] * math.log2(1 + n)
        p = [1 / (1 + math.exp(-max(-40, min(40, eta - c)))) for c in cuts] if t else [0.0]
        assert abs(got[i]["severity"] - sum(p)) < 1e-4 and abs(got[i]["p_toxic"] - p[0]) < 1e-4 and got[i]["toxic"] == (got[i]["p_toxic"] >= toxicity.REJECT)


def test_toxicity_on_held_out_labels(spark):
    from pyspark.sql import functions as F

    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    model = toxicity.train(docs, toxicity.grades_of(labels.where(~held)))
    scored = toxicity.score(docs, model).join(labels.where(held), "doc_id").withColumn("hit", (F.col("p_toxic") >= toxicity.REJECT).cast("int"))
    rate = {r["toxic"]: r["rate"] for r in scored.groupBy("toxic").agg(F.avg("hit").alias("rate")).collect()}
    assert rate[1] >= 0.9 and rate[0] <= 0.01


def lines_of(text):
    parts = re.split("(?<=\n)", text)
    return parts if parts[-1] else parts[:-1]


def test_merkle_pairs(spark, texts):
    got = {r["doc_id"]: r for r in queries.op10_merkle_fingerprint(spark, DATA).collect()}
    ids = list(texts)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[i], texts[after]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = merkle.fingerprint(t), merkle.fingerprint(edited), merkle.fingerprint(n)
        assert tuple(got[i])[1:] == (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, c), got[i]["changed"])
        # Paragraphs of the edited text that the text lacks, each of the text's used once.
        left, lacks = Counter(lines_of(t)), []
        for k, line in enumerate(lines_of(edited)):
            if left[line] > 0:
                left[line] -= 1
            else:
                lacks.append(k)
        assert len(got[i]["changed"]) == len(lacks)
        assert t == n or got[i]["near_edited"] > got[i]["near_next"]


def covered(rows, removed):
    out = defaultdict(set)
    for r in rows:
        if r["removed"] == removed:
            out[r["doc_id"]] |= set(range(r["first_word"], r["first_word"] + r["n_words"]))
    return out


def test_repeated_passages(spark, texts):
    """Paragraph classes, exact Jaccard and components, and equal runs of 15 and 50 words, all by plain loops."""
    got = substring.repeated_passages(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    removed, stays = covered(got, True), covered(got, False)
    paragraphs, words = [], {}
    for i, t in texts.items():
        words[i] = t.lower().split()
        at = 0
        for line in t.lower().split("\n"):
            w = tuple(line.split())
            if w:
                paragraphs.append((i, at, w))
            at += len(w)
    classes = sorted({w for _, _, w in paragraphs})
    sets = {w: {w[k : k + 5] for k in range(max(1, len(w) - 4))} for w in classes}
    root = {w: w for w in classes}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    holds = defaultdict(list)
    for w in classes:
        for g in sets[w]:
            holds[g].append(w)
    for w in classes:
        for v in {v for g in sets[w] for v in holds[g]}:
            if v != w and 100 * len(sets[w] & sets[v]) >= 80 * len(sets[w] | sets[v]):
                root[find(v)] = find(w)
    clusters = defaultdict(list)
    for i, at, w in paragraphs:
        clusters[find(w)].append((i, at, len(w)))
    near = defaultdict(set)
    for places in clusters.values():
        if len(places) > 1:
            first, *later = sorted(places)
            assert set(range(first[1], first[1] + first[2])) <= stays[first[0]] | removed[first[0]]
            for i, at, n in later:
                near[i] |= set(range(at, at + n))
                assert near[i] <= removed[i]
    runs = {n: defaultdict(list) for n in (15, 50)}
    for i, w in words.items():
        for n in runs:
            for k in range(len(w) - n + 1):
                runs[n][tuple(w[k : k + n])].append((i, k))
    repeated = {n: defaultdict(set) for n in runs}
    for n in runs:
        for places in runs[n].values():
            first, *later = sorted(places)
            for i, k in later:
                # A text that repeats itself word by word keeps its begin, however long one takes that to be.
                if n == 15 or i != first[0] or k >= first[1] + n:
                    repeated[n][i] |= set(range(k, k + n))
    for i in words:
        assert repeated[50][i] <= removed[i] and removed[i] <= near[i] | repeated[15][i] | {k for k in range(len(words[i])) if texts[i] in (texts[j] for j in words if j < i)}
    assert sum(map(len, repeated[50].values())) > 1000


def test_pasted_passages_are_covered(spark):
    """Passages of 51 to 60 words at any place of a paragraph are reported word for word."""
    rnd, rows, want = random.Random(5), [], {}
    for i in range(150):
        n = rnd.randint(51, 60)
        passage = " ".join(f"p{i}x{k}" for k in range(n))
        for side in (0, 1):
            before, after = rnd.randint(0, 70), rnd.randint(0, 70)
            rows.append((2 * i + side, " ".join([*(f"a{i}x{side}x{k}" for k in range(before)), passage, *(f"b{i}x{side}x{k}" for k in range(after))])))
            want[2 * i + side] = (before, n, side == 1)
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), run=15).collect()
    assert {r["doc_id"]: (r["first_word"], r["n_words"], r["removed"]) for r in got} == want and len(got) == len(want)


def test_perplexity_is_kneser_ney(spark, texts):
    """Modified Kneser-Ney counts, discounts, back-off and perplexity of every document by plain dictionaries."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    fitting = {r["doc_id"] for r in labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(perplexity.HELD_OUT)) != 0).collect()} & texts.keys()
    marked = {i: "\x02" * 4 + "".join("\ufffd" if ord(c) < 9 else c for c in t) for i, t in texts.items()}
    counts = {5: Counter(m[k : k + 5] for i in fitting for m in [marked[i]] for k in range(len(m) - 4))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, total, taken = {}, {}, {}
    for k, own in counts.items():
        n = [sum(v == j for v in own.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [j - (j + 1) * y * n[j] / n[j - 1] if n[j - 1] else 0.5 * j for j in (1, 2, 3)]
        discount[k] = [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95))]
        total[k], taken[k] = Counter(), Counter()
        for g, v in own.items():
            total[k][g[:-1]] += v
            taken[k][g[:-1]] += discount[k][min(v, 3) - 1]

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        k, context = len(gram), gram[:-1]
        if context not in total[k]:
            return p(gram[1:])
        n = counts[k][gram]
        return (n - (discount[k][min(n, 3) - 1] if n else 0) + taken[k][context] * p(gram[1:])) / total[k][context]

    got = {r["doc_id"]: r["perplexity"] for r in queries.op8_quality_perplexity(spark, DATA).collect()}
    known = {}
    for i, m in marked.items():
        logs = [known[g] if (g := m[k : k + 5]) in known else known.setdefault(g, math.log(p(g))) for k in range(len(m) - 4)]
        assert (got[i] is None and not logs) or abs(got[i] / math.exp(-sum(logs) / len(logs)) - 1) < 1e-6


def test_quality_follows_the_labels(spark):
    kept = {r["doc_id"]: r["kept"] for r in queries.op8_quality_perplexity(spark, DATA).collect()}
    labels = pq.read_table(f"{DATA}/labels.parquet").to_pydict()
    good = [kept[i] for i, q in zip(labels["doc_id"], labels["quality"]) if q == 1]
    bad = [kept[i] for i, q in zip(labels["doc_id"], labels["quality"]) if q == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_quality_on_a_larger_table(spark):
    """With held-out texts enough in each language, nine of ten bad texts go and nearly all good ones stay."""
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    judged = queries.op8_quality_perplexity(spark, path).join(labels, "doc_id").selectExpr("quality", "cast(kept as int) AS kept").groupBy("quality").avg("kept").collect()
    rate = {r[0]: r[1] for r in judged}
    assert rate[1] >= 0.97 and rate[0] <= 0.1


def test_pipeline(spark, texts):
    """The stages one by one: what each takes away is checked against its own rule."""
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "decontamination", "byte_bpe"] and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    toxic = {r["doc_id"] for r in queries.op5_toxicity(spark, DATA).where("toxic").collect()}
    one = p.STAGES[0][1](spark, docs, DATA)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == texts.keys() - toxic
    two = p.STAGES[1][1](spark, one, DATA)
    kept, seen = {}, set()
    for i in sorted(texts.keys() - toxic):
        lines = texts[i].split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in seen and "".join(window).strip():
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        kept[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in two.collect()} == {i: (t, len(t)) for i, t in kept.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in kept.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    three = p.STAGES[2][1](spark, two, DATA)
    reps = {i for i in root if find(i) == i}
    assert {r["doc_id"] for r in three.collect()} == reps
    four = p.STAGES[3][1](spark, three, DATA)
    items = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for t in pq.read_table(f"{DATA}/benchmark.parquet").to_pydict()["text"] if len(w := t.lower().split()) >= 5]
    clean = {i for i in reps if not any(100 * len(sets[i] & x) >= 80 * len(x) for x in items)}
    assert {r["doc_id"] for r in four.collect()} == clean and clean < reps
    assert {r["doc_id"] for r in p.run(spark, DATA).collect()} == clean
