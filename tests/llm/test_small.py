"""Odd rows for every operator: nulls, empty texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assayer.llm import bpe, chat, decontam, lines, merkle, minhash, perplexity, pii, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))


def odd(spark):
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "a b c d e f g h"), (5, "other words under the same id here"), (None, "a b c d e f g h"), (7, LONG), (8, "é😀 ß x"), (9, "x" * 30_000)]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)
    return rows.withColumns({"severity": F.lit("mine"), "part": F.lit(1), "key": F.lit("k"), "kept": F.lit(None).cast("boolean"), "mark": F.lit(0)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a\\</s>"), (1, 1, "assistant", "a\\</s>"), (None, 3, None, "x"), (2, None, "tool", "")], "conv_id long, turn long, role string, text string")
    got = {r["tree"]: r for r in chat.read_back(chat.format_paths(chat.chains(rows))).collect()}
    assert got["1"]["n_turns"] == 3 and got["1"]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\na\\</s>\nassistant\na\\</s>\n").hexdigest()
    assert got["1"]["loss_chars"] == 12 and got["1"]["loss_sha256"] == hashlib.sha256(b"a\\</s>a\\</s>").hexdigest()
    assert got[""]["n_turns"] == 1 and got["2"]["loss_chars"] == 0
    assert chat.format_paths(chat.chains(rows.limit(0))).count() == 0


def test_chat_trees(spark):
    rows = [("t", 1, None, 0.0, "user", "root"), ("t", 2, 1, 1.0, "assistant", "good"), ("t", 3, 1, 5.0, "assistant", "better"), ("t", 4, 3, None, "user", "then"), ("t", 5, 2, 0.5, "user", "so"), ("t", 6, 99, 0.0, "user", "orphan"), ("u", 1, 2, 0.0, "user", "circle"), ("u", 2, 1, 0.0, "user", "circle")]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    best = chat.format_paths(m, 1).collect()
    assert len(best) == 1 and [t for _, t in chat.read_turns(best[0]["formatted"])] == ["root", "better", "then"] and best[0]["path_score"] == 5.0
    two = {r["leaf"]: [t for _, t in chat.read_turns(r["formatted"])] for r in chat.format_paths(m, 3).collect()}
    assert two == {4: ["root", "better", "then"], 5: ["root", "good", "so"], 6: ["orphan"]}


@pytest.mark.parametrize("text", ["", "\\", "<s>", "a<", "[/INST]</s><\\s>", "\\\\[INST]", "[", "<</s>", "x\\n"])
def test_chat_escapes(text):
    formatted, spans = chat.format_turns([("user", text), ("assistant", text), (text, text)])
    assert chat.read_turns(formatted) == [("user", text), ("assistant", text), (text, text)]
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [text]


def test_pii(spark):
    got = pii.find(odd(spark))
    assert got.count() == odd(spark).count() and got.where("base <> ''").count() == 0
    assert pii.find(empty(spark)).count() == 0


def test_minhash(spark):
    got = minhash.near_duplicates(odd(spark), k=4).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == 11 and all(r["component_id"] == 1 and r["n_shingles"] == 0 for r in by[1])
    assert [r["kept"] for r in by[4]] == [True, True] and by[None][0]["kept"] and by[None][0]["component_id"] is None
    assert {r["component_id"] for r in by[5]} == {5} and by[9][0]["n_shingles"] == 1
    assert minhash.near_duplicates(empty(spark)).count() == 0
    words = {c: " ".join(f"{c}{i}" for i in range(9)) for c in "abc"}
    rows = [(3, "a"), (5, "a"), (5, "b"), (9, "b"), (10, "c")]
    for more in ([], [(11, "c")]):
        both = minhash.near_duplicates(spark.createDataFrame([(i, words[c]) for i, c in rows + more] + [(5, "")], "doc_id long, text string"), k=4).collect()
        assert {(r["doc_id"], r["component_id"]) for r in both} == {(3, 3), (5, 3), (9, 3), (10, 10)} | {(i, 10) for i, _ in more}
    assert minhash.keep_one(odd(spark)).columns == odd(spark).columns


def test_bpe(spark):
    got = bpe.round_trip(odd(spark), RANKS, PATTERN).collect()
    assert len(got) == 11
    for r in got:
        if r["doc_id"] == 1:
            assert r["n_tokens"] == 0 and r["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
        if r["doc_id"] == 8:
            assert r["decoded_sha256"] == hashlib.sha256("é😀 ß x".encode()).hexdigest()
    assert bpe.round_trip(empty(spark), RANKS, PATTERN).count() == 0
    tokens = bpe.encode(odd(spark).where("doc_id = 8"), RANKS, PATTERN)
    assert bytes(bpe.decode(tokens, RANKS, PATTERN).first()["decoded"]).decode() == "é😀 ß x"
    assert bytes(bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS, PATTERN).first()["decoded"]) == b""


def test_toxicity(spark):
    docs = spark.createDataFrame([(i, "nasty word " * (i % 2) + f"plain text {i} of words") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (999, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, toxicity.grades_of(labels))
    got = toxicity.score(odd(spark), model)
    assert got.columns[-2:] == ["severity", "p_toxic"] and got.where("text is null or text = ''").agg(F.sum("p_toxic")).first()[0] == 0
    assert [r["doc_id"] for r in toxicity.score(docs, model).where("p_toxic >= 0.5").orderBy("doc_id").collect()] == list(range(1, 40, 2))
    none = toxicity.train(docs, toxicity.grades_of(labels.where("toxic = 0")))
    assert toxicity.score(docs, none).where("p_toxic >= 0.5").count() == 0
    assert toxicity.score(empty(spark), model).count() == 0
    kept = toxicity.drop_toxic(odd(spark), labels.where("doc_id > 20"))
    assert kept.columns == odd(spark).columns and kept.count() == 11


def test_one_text_of_an_id_is_fitted(spark):
    """Of several texts of one id always the same one is used, in whatever order they come."""
    docs = spark.createDataFrame([(i, f"text {i} {'nasty' if i % 2 else 'calm'} version {v}") for i in range(12) for v in range(3)], "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, grade long")
    one, other = (sorted(map(repr, toxicity.featured(d, grades).collect())) for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(5)))
    assert one == other and len(one) == 12


def test_grades_are_ordered(spark):
    """Held-out expected severity rises with the grade."""
    words = ["calm quiet", "rude calm", "rude vile"]
    docs = spark.createDataFrame([(i, f"{words[i % 3]} text number {i}") for i in range(90)], "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade long")
    got = toxicity.score(docs, toxicity.train(docs, grades)).where("doc_id >= 60").groupBy((F.col("doc_id") % 3).alias("g")).agg(F.avg("severity").alias("s")).orderBy("g").collect()
    assert got[0]["s"] < 0.5 < got[1]["s"] < 1.5 < got[2]["s"]


def test_substring(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    fill = lambda n, k: " ".join(f"{k}{i}" for i in range(n))
    docs = spark.createDataFrame([(1, f"{fill(30, 'a')} {passage} {fill(9, 'b')}"), (2, f"{fill(3, 'c')} {passage} {fill(40, 'd')}\n{fill(8, 'e')}"), (3, fill(90, "f")), (None, fill(60, "g")), (4, None), (5, "")], "doc_id long, text string")
    got = substring.repeated_passages(docs).collect()
    assert sorted((r["doc_id"], r["first_word"], r["n_words"], r["removed"]) for r in got) == [(1, 30, 55, False), (2, 3, 55, True)]
    out = {r["doc_id"]: r["text"] for r in substring.remove_passages(docs).collect()}
    assert out[3] == fill(90, "f") and out[4] is None and out[2].split() == [*fill(3, "c").split(), *fill(40, "d").split(), *fill(8, "e").split()]
    assert substring.repeated_passages(empty(spark)).count() == 0
    copies = {(r["doc_id"], r["n_words"], r["removed"]) for r in substring.repeated_passages(odd(spark)).collect()}
    assert {c for c in copies if c[0] != 7} == {(None, 8, False), (5, 8, True)} and all(c[0] == 7 for c in copies - {(None, 8, False), (5, 8, True)})
    assert substring.remove_passages(odd(spark)).columns == odd(spark).columns and substring.remove_passages(odd(spark)).count() == 11
    short = [(1, fill(8, "p")), (2, "x y z\n" + fill(8, "p")), (3, fill(18, "q")), (4, fill(18, "q").replace("q17", "other")), (5, fill(4, "r")), (6, fill(4, "r") + " s")]
    found = substring.repeated_passages(spark.createDataFrame(short, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["first_word"], r["n_words"], r["removed"]) for r in found) == [(1, 0, 8, False), (2, 3, 8, True), (3, 0, 18, False), (4, 0, 18, True)]
    near = " ".join(f"n{i}" for i in range(100))
    pair = spark.createDataFrame([(1, near), (2, near.replace("n50 ", "other "))], "doc_id long, text string")
    assert {r["doc_id"] for r in substring.repeated_passages(pair).where("removed and n_words = 100").collect()} == {2}


def test_lines(spark):
    t = "a\nb\nc\nd"
    docs = spark.createDataFrame([(1, t), (2, "x\n" + t), (2, "x\n" + t), (3, None), (4, ""), (5, "a\na\na\na\na"), (6, "\n\n\n\n"), (None, "b\nc\nd\ne")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in lines.remove_repeats(docs).collect()), key=repr)
    # The null id comes first, so its lines stay and the others lose them.
    assert got == sorted([(0, "b\nc\nd\ne"), (1, "a"), (2, "x"), (2, "x"), (3, None), (4, ""), (5, "a"), (6, "\n\n\n\n")], key=repr)
    assert lines.clean(odd(spark)).columns == odd(spark).columns and lines.clean(empty(spark)).count() == 0


def test_perplexity(spark):
    docs = spark.createDataFrame([(i, f"the cat sat on the mat {i % 7} and the dog ran", "en") for i in range(60)] + [(100, "ZZQX!!@@ XQZ", "en"), (101, None, "en"), (102, "", None), (None, "the cat", None)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(60)] + [(None,)], "doc_id long")
    a = {(r["doc_id"], r["lang"]): r for r in perplexity.judge(docs, trusted).collect()}
    assert not a[100, "en"]["kept"] and a[101, "en"]["perplexity"] is None and not a[101, "en"]["kept"] and sum(r["kept"] for r in a.values()) >= 58
    b = {(r["doc_id"], r["lang"]): r for r in perplexity.judge(docs, trusted, block=100).collect()}
    assert a.keys() == b.keys() and all(a[k]["perplexity"] is None or abs(a[k]["perplexity"] - b[k]["perplexity"]) < 1e-9 for k in a)
    assert perplexity.judge(docs, trusted.limit(0)).where("kept").count() == 62
    assert perplexity.judge(empty(spark), trusted).count() == 0


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("abracadabra alakazam",), ("abc abd acd",)], "text string")
    model = perplexity.build(perplexity.count_ngrams(docs))
    chars = sorted(set("abracadabra alakazamabc abd acd")) + ["Ω"]
    for context in ("abra", " aba", "zzzz"):
        grams = spark.createDataFrame([(context + c,) for c in chars], "gram string")
        assert abs(perplexity.resolved(grams, model).agg(F.sum(F.exp("p"))).first()[0] - 1) < 1e-9


def test_decontam(spark):
    item = " ".join(f"q{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "Held Whole"), (None, item), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, LONG + " " + item.upper() + "\n" + LONG), (2, item), (2, "x"), (3, item[: len(item) // 2]), (None, item), (4, None), (5, "it is held whole"), (6, "held whole"), (7, "held the whole held"), (8, "whole held")], "doc_id long, text string")
    assert sorted(map(tuple, decontam.contained_items(docs, items).collect())) == [(1, 1, 26, 26), (2, 1, 26, 26), (5, 3, 1, 1), (6, 3, 1, 1)]
    assert decontam.contained_items(empty(spark), items).count() == 0 and decontam.contained_items(docs, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(odd(spark), items).columns == odd(spark).columns and decontam.drop_contaminated(docs, items).count() == 5


def test_short_items_are_all_found(spark):
    """Items of 1 to 16 words (1 to 12 shingles), each in a long document of its own."""
    short = [(n * 1000 + i, " ".join(f"s{n}x{i}x{j}" for j in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 15, 16) for i in range(60)]
    items = spark.createDataFrame(short, "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"f{i}x{j}" for j in range(40 + i % 97)) + f" {t} " + " ".join(f"g{i}x{j}" for j in range(30))) for i, t in short], "doc_id long, text string")
    assert sorted(map(tuple, decontam.contained_items(docs, items).collect())) == [(i, i, max(1, i // 1000 - 4), max(1, i // 1000 - 4)) for i, _ in short]


def test_merkle(spark):
    got = merkle.edited_pairs(odd(spark), parts=3).collect()
    assert len(got) == 11
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd(spark).select("doc_id", "text").collect() if r["doc_id"] not in (None, 4, 5)), key=lambda r: r[0])
    for r in got:
        if r["doc_id"] in (7, 8):
            text = dict(rows)[r["doc_id"]]
            after = dict(rows)[r["doc_id"] + 1]
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["fingerprint"] == merkle.fingerprint(text)
    assert merkle.edited_pairs(empty(spark)).count() == 0
    assert merkle.edited_pairs(odd(spark).where("doc_id = 8")).count() == 1
    assert merkle.fingerprints(odd(spark)).count() == 11
    pairs = spark.createDataFrame([(merkle.fingerprint("a\nb"), merkle.fingerprint("a\nc"), 1), (None, "x", 2), (merkle.fingerprint(""), merkle.fingerprint(""), 3)], "fingerprint string, edited_fingerprint string, changed int")
    assert [r["changed"] for r in merkle.edits(pairs).collect()] == [[1], None, []]


def test_merkle_tree_finds_the_edit():
    text = "\n".join(f"paragraph {i} says something of its own, number {i * i}" for i in range(60))
    edited = text.replace("paragraph 33 says", "paragraph 33 said")
    a, b = merkle.fingerprint(text), merkle.fingerprint(edited)
    assert a != b and merkle.differences(b, a) == [33] and merkle.differences(a, a) == [] and 0.9 < merkle.likeness(a, b) < 1
    assert merkle.likeness("x/", "y/") == 0.0 and merkle.likeness(a, a) == 1.0


INTERNAL = ["_severity", "_p_toxic", "_doc", "_mark", "_gone", "_d", "_m", "_cut", "doc", "mark", "gone", "severity", "p_toxic", "shingles", "key", "size", "ids", "item_id", "component", "_severity_"]


@pytest.mark.parametrize("stage", ["toxicity", "lines", "near", "benchmark", "passages"])
def test_columns_of_internal_names_stay(spark, stage):
    """Extra columns of every name an operator uses itself keep their values; no row with them is lost or changed."""
    block = "first line here\nsecond line here\nthird line here"
    texts = [(1, block), (2, block + "\nand one more"), (3, "clean words that stand alone in this text here"), (4, None), (5, ""), (None, "clean and without an id of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA).withColumns({n: F.concat(F.lit("mine-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in INTERNAL})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 4)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "this item is nowhere in these texts at all")], "item_id long, text string")
    out = {
        "toxicity": lambda d: toxicity.drop_toxic(d, labels), "lines": lines.clean, "near": lambda d: minhash.keep_one(d), "benchmark": lambda d: decontam.drop_contaminated(d, items),
        "passages": lambda d: substring.remove_passages(d, run=3),
    }[stage]
    got = out(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[n] == f"mine-{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in INTERNAL)
    assert {r["doc_id"] for r in rows} >= {1, 3, None} and (stage == "near" or len(rows) == 6)
    assert out(docs.limit(0)).count() == 0


def test_short_paragraphs_of_equal_shingles(spark):
    """Six words each, in another order: the same five-word shingles; one word more: two of three shared."""
    pairs = spark.createDataFrame([(1, "a b a b a b"), (2, "b a b a b a"), (3, "c d e f g h"), (4, "c d e f g h i"), (5, "k l m n o"), (6, "k l m n o p")], "doc_id long, text string")
    linked = lambda percent: {r["doc_id"] for r in substring.repeated_passages(pairs, percent).collect()}
    assert linked(80) == {1, 2} and linked(60) == {1, 2, 3, 4} and linked(50) == {1, 2, 3, 4, 5, 6}


def test_perplexity_in_few_buckets(spark, monkeypatch):
    """Many blocks in a few buckets, shuffled before they are written or not: the same perplexities, and no table or file left."""
    docs = spark.createDataFrame([(i, f"some words of text number {i} and more of it {i * 7919 % 13}", "en") for i in range(60)], "doc_id long, text string, lang string")
    model = perplexity.build(perplexity.count_ngrams(docs))
    want = sorted(map(tuple, perplexity.score(docs, model).collect()))
    before = {r["tableName"] for r in spark.sql("SHOW TABLES").collect()}
    for buckets, files in ((10_000, 10_000), (3, 10_000), (3, 1)):
        monkeypatch.setattr(perplexity, "BUCKETS", buckets)
        monkeypatch.setattr(perplexity, "FILES", files)
        assert sorted(map(tuple, perplexity.score(docs, model, block=200).collect())) == want
    assert {r["tableName"] for r in spark.sql("SHOW TABLES").collect()} == before


def test_merkle_ranges(spark):
    """As many ranges as asked for, also of rows that share an id; every neighbour is right."""
    texts = [(i // 3 if i < 60 else 1000 if i < 90 else i, f"text {i} " + "w" * (i % 7)) for i in range(200)] + [(500, "same")] * 20
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pairs = merkle.edited_pairs(docs, parts=37)
    assert pairs.rdd.getNumPartitions() > 30
    hashed = docs.withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h").collect()
    want = []
    for a, b in zip(hashed, hashed[1:] + hashed[:1]):
        half = len(a["text"]) // 2
        edited = a["text"][: len(a["text"]) - half] + b["text"][:half]
        want.append((a["doc_id"], len(a["text"]), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in pairs.collect()) == sorted(want)


def test_decontam_stock_phrase(spark):
    """2000 items with one stock phrase against 2000 documents that hold it: only pairs by other words; all items are found."""
    phrase = "which of the following is the right one"
    items = spark.range(2000).select(F.col("id").alias("item_id"), F.concat(F.lit(phrase), *[F.concat(F.lit(f" q{j}x"), "id") for j in range(14)]).alias("text"))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(*[F.concat(F.lit(f"d{j}x"), "id", F.lit(" ")) for j in range(60)], F.lit(phrase), *[F.when(F.col("id") < 200, F.concat(F.lit(f" q{j}x"), "id")).otherwise(F.lit(f" z{j}")) for j in range(14)]).alias("text"))
    seen = []
    whole = decontam.candidates
    decontam.candidates = lambda *a: seen.append(whole(*a)) or seen[-1]
    try:
        got = {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(docs, items).collect()}
    finally:
        decontam.candidates = whole
    assert got == {(i, i) for i in range(200)} and seen[0].count() < 4000


def test_chains_by_ids(spark):
    """Places found on ids alone give what messages with their texts give: repeated rows, nulls in every column, roles and texts that swap."""
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (0, 0, 1, None) for r, x in (("a", None), (None, "a"), ("", "a"), ("assistant", "b"), ("assistant", "b"), (None, None))] + [(7, 1, "user", LONG)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    both = [sorted(map(tuple, f.select("tree", "leaf", "path_score", "formatted", F.to_json("loss")).collect())) for f in (chat.format_chains(given), chat.format_paths(chat.chains(given)))]
    assert len(both[0]) == 4 and both[0] == both[1] and sum(len(chat.read_turns(r[3])) for r in both[0]) == len(rows)
    assert chat.format_chains(given.limit(0)).count() == 0
