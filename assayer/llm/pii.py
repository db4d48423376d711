"""Personal data and the terms that give it away, by DataFrame functions only (operator 2).

Base spans are the leftmost non-overlapping matches of one pattern for each kind that pass its
test (card: Luhn; ip: parts to 255; phone and card: number of digits).  Offsets are those of code
points, from the lengths of the pieces between matches.

Added spans come from the corpus.  Entities (base values) that stand in
exactly the same documents, two different texts among them, are one class.  A term (a run of three
letters or more, outside email addresses) reveals a class c by its pointwise mutual information as
a share of the class's own information, ln(N n(c,t) / (n(c) n(t))) / ln(N / n(c)), with the document
counts n over all documents; n(t) is counted over the whole table.  Where term and class meet
in two different texts at least and that share is ``disclosure`` or more, the term's occurrences in
documents of the class are spans of kind ``term``; from ``removal`` on they are removed, below
it generalised to a placeholder.  A document without a base entity gets no added span.

An entity that stands in one text only has met each term of that text once.  Its share is smoothed by
``BACKING`` pseudo-meetings, dealt as the entities of its kind k meet the term in other texts:
P = (1 + BACKING m(k,t) / m(k)) / (1 + BACKING) and ln(M P / m(t)) / ln(M), where M, m(t), m(k) and m(k,t) are
numbers of different texts (of other ones for m(k) and m(k,t)), so exact copies count once and back nothing.

Rows: a null text is empty; every row gives a row; rows with equal id and text are one document and get equal
results; rows that share only the id are told apart by their texts.  Other columns are not looked at.

The patterns are possessive or start where a run starts, so that they take linear time and no
stack on texts of any length, and give the same matches as the plain ones named in ``PLAIN``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import _graph

KINDS = ("email", "ip", "card", "phone")

#: The patterns as given.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: An email starts where a run of its characters starts or where the last one ended.  A card's digits go on as far
#: as they can, so the number of digits can be part of the pattern.
FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

TERM = r"[\p{L}\p{M}]{3,}+"
DISCLOSURE, REMOVAL = 0.9, 0.98
#: With this, one meeting reaches ``DISCLOSURE`` from 270 different texts on.
BACKING = 0.75


def _found(kind: str, text: Column, pattern: str) -> Column:
    """Every match with its number, its length and the length of the text between it and the one before."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.transform(F.arrays_zip(matches.alias("m"), pieces.alias("p")), lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["m"]).alias("size"), F.length(z["p"]).alias("gap"), z["m"].alias("value")))
    none = F.array().cast("array<struct<kind: string, i: int, size: int, gap: int, value: string>>")
    # The last piece has no match after it.
    return F.when(F.size(matches) > 0, F.filter(rows, lambda r: r["value"].isNotNull())).otherwise(none)


def _passes(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    part = lambda p: F.regexp_replace(p, "^0+", "")
    ip = F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * (1 + i % 2))
    luhn = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0
    return F.when(kind == "ip", ip).when(kind == "card", n.between(12, 19) & luhn).when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True))


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _spans(given: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(doc, mark, kind, start, end, value) of all matches of the patterns."""
    text = F.col("text")
    needs = {"email": "@", "phone": "+", "ip": "."}
    parts = [F.when(text.contains(needs[k]), _found(k, text, p)) if k in needs else _found(k, text, p) for k, p in patterns.items()]
    none = F.array().cast("array<struct<kind: string, i: int, size: int, gap: int, value: string>>")
    rows = given.select("doc", "mark", F.concat(*[F.coalesce(p, none) for p in parts]).alias("s")).where(F.size("s") > 0)
    rows = rows.select("doc", "mark", F.explode("s").alias("s")).select("doc", "mark", "s.*")
    rows = rows.repartition("doc", "mark").dropDuplicates(["doc", "mark", "kind", "i"])
    upto = Window.partitionBy("doc", "mark", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto).cast("long")
    return rows.withColumn("end", end).select("doc", "mark", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def base_spans(given: DataFrame) -> DataFrame:
    return _spans(given, FAST).where(_passes(F.col("kind"), F.col("value")))


def _terms(text: Column) -> Column:
    """Distinct terms of a text, lower-cased, outside email addresses."""
    bare = F.when(text.contains("@"), F.regexp_replace(text, FAST["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0)))


def _counts(given: DataFrame, copies: DataFrame) -> DataFrame:
    """(term, n_t, m_t): documents with the term, and different texts with it, counted in one pass over the texts."""
    # Each copy of a text counts as its share of one text.
    repeated = _graph.small(_graph.saved(copies.where("copies > 1")))
    weight = F.lit(1.0) / F.coalesce("copies", F.lit(1))
    spread = given.join(repeated, "mark", "left").select(F.explode(_terms(F.col("text"))).alias("term"), weight.alias("weight"))
    return _graph.saved(spread.groupBy("term").agg(F.count("*").alias("n_t"), F.round(F.sum("weight")).cast("long").alias("m_t")))


def _revealing_once(given: DataFrame, held: DataFrame, counts: DataFrame, texts: int, disclosure: float) -> DataFrame:
    """(doc, mark, term, share): terms that reveal an entity of one text; ``held`` has (doc, mark, kind, entity)."""
    single = held.groupBy("entity").agg(F.min("mark").alias("mark"), F.max("mark").alias("other"), F.min("kind").alias("kind")).where("mark = other")
    single = _graph.saved(single.select("mark", "kind").distinct())
    kinds = _graph.saved(held.select("mark", "kind").distinct())
    inside = _graph.small(_graph.saved(kinds.select("mark").distinct()))
    own = given.join(inside, "mark", "left_semi").dropDuplicates(["mark"]).select("mark", F.explode(_terms(F.col("text"))).alias("term"))
    own = _graph.saved(own)
    share = lambda p: F.log(texts * p / F.col("m_t")) / math.log(max(texts, 2))
    # At best the entities of the kind all meet the term: terms of more texts need not be looked at.
    own = _graph.saved(own.join(counts.select("term", "m_t").where(share(F.lit(1.0)) >= disclosure - 1e-9), "term"))
    met = own.join(kinds, "mark").groupBy("kind", "term").agg(F.count("*").alias("m_kt"))
    of_kind = kinds.groupBy("kind").agg(F.count("*").alias("m_k"))
    told = own.join(single, "mark").join(met, ["kind", "term"]).join(F.broadcast(of_kind), "kind")
    backed = F.when(F.col("m_k") > 1, (F.col("m_kt") - 1) / (F.col("m_k") - 1)).otherwise(0.0)
    told = told.withColumn("share", share((1 + BACKING * backed) / (1 + BACKING))).where(F.col("share") >= disclosure)
    told = told.groupBy("mark", "term").agg(F.max("share").alias("share"))
    return held.select("doc", "mark").distinct().join(told, "mark").select("doc", "mark", "term", "share")


def revealing(given: DataFrame, base: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc, mark, term, share): terms that reveal an entity of their document."""
    value = F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("value", "[^0-9]", "")).otherwise(F.lower("value"))
    held = _graph.saved(base.select("doc", "mark", "kind", F.concat("kind", F.lit(":"), value).alias("entity")).distinct())
    copies = _graph.saved(given.groupBy("mark").agg(F.count("*").alias("copies")))
    n, texts = copies.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    counts = _counts(given, copies)
    once = _revealing_once(given, held, counts, texts, disclosure)
    where = F.xxhash64("doc", "mark").cast("decimal(38,0)")
    stats = held.groupBy("entity").agg(F.count("*").alias("n_c"), F.sum(where).alias("places"), F.min("mark").alias("one"), F.max("mark").alias("other"))
    stats = stats.where("one < other").select("entity", "n_c", F.xxhash64("n_c", "places").alias("class"))
    held = _graph.saved(held.join(stats, "entity").select("doc", "mark", "class", "n_c").distinct())
    inside = _graph.saved(held.select("doc", "mark").distinct())
    marked = inside.select(F.col("doc").alias("d"), F.col("mark").alias("m"))
    own = given.join(_graph.small(marked), F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left_semi")
    own = _graph.saved(own.dropDuplicates(["doc", "mark"]).select("doc", "mark", F.explode(_terms(F.col("text"))).alias("term")))
    supported = own.groupBy("term").agg(F.min("mark").alias("one"), F.max("mark").alias("other")).where("one < other").select("term")
    supported = _graph.saved(supported.join(counts.select("term", "n_t"), "term"))
    pairs = own.join(supported, "term").alias("o").join(held.alias("h"), F.col("o.doc").eqNullSafe(F.col("h.doc")) & (F.col("o.mark") == F.col("h.mark")))
    most = lambda met: F.log(n * met / (F.col("n_c") * F.col("n_t"))) / F.log(n / F.col("n_c"))
    # A term met n(c) times reveals most; rarer meetings only less: others need not be counted.
    pairs = pairs.where(F.col("n_c") < n).where(most(F.least("n_c", "n_t")) >= disclosure - 1e-9).select("o.doc", "o.mark", "term", "class", "n_c", "n_t")
    pairs = _graph.saved(pairs)
    met = pairs.groupBy("class", "term", "n_c", "n_t").agg(F.count("*").alias("n_ct"), F.min("mark").alias("one"), F.max("mark").alias("other")).where("one < other")
    met = met.withColumn("share", most(F.col("n_ct"))).where(F.col("share") >= disclosure).select("class", "term", "share")
    told = pairs.join(met, ["class", "term"]).select("doc", "mark", "term", "share").union(once)
    return told.groupBy("doc", "mark", "term").agg(F.max("share").alias("share"))


def all_spans(given: DataFrame, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """Base spans and the added ones (kind ``term``, with ``share``), which never overlap base spans."""
    base = _graph.saved(base_spans(given))
    told = _graph.saved(revealing(given, base, disclosure).withColumnsRenamed({"doc": "d", "mark": "m"}))
    texts = _graph.small(_graph.saved(told.select("d", "m").distinct()))
    at = F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    words = _spans(given.join(texts, at, "left_semi"), {"term": TERM})
    words = words.join(told, at & (F.lower("value") == F.col("term"))).select("doc", "mark", "kind", "start", "end", "value", "share")
    both = words.unionByName(base.withColumn("share", F.lit(None).cast("double")).where("kind = 'email'"))
    turn = Window.partitionBy("doc", "mark").orderBy("start", "end")
    email = F.col("kind") == "email"
    before = F.max(F.when(email, F.col("end"))).over(turn.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(email, F.col("start"))).over(turn.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("before", before).withColumn("after", after)
    added = both.where(~email).where((F.coalesce("before", "start") <= F.col("start")) & (F.coalesce("after", "end") >= F.col("end")))
    return base, added.select("doc", "mark", "kind", "start", "end", "value", "share")


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "term")]), s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, disclosure: float = DISCLOSURE, removal: float = REMOVAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base, spans, text, sanitised) of every row.

    ``base`` and ``spans`` are texts of kind:start:end by start, then kind; ``sanitised`` has a placeholder
    for every span but the terms that are removed; where spans overlap, the one that starts first is replaced
    (of equal starts, the first kind).
    """
    given = _given(docs, id_col, text_col)
    base, added = all_spans(given, disclosure)
    every = base.withColumn("share", F.lit(None).cast("double")).unionByName(added)
    number = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term")]), F.col("kind")).cast("int")
    every = every.groupBy("doc", "mark").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in (*KINDS, "term")], F.sort_array(F.collect_list(F.struct("start", number.alias("k"), "end", "share"))).alias("s")
    )
    every = _graph.saved(every.withColumnsRenamed({"doc": "d", "mark": "m"}))
    places = every.agg(F.coalesce(F.sum(F.size("s") + 4), F.lit(0))).first()[0]
    every = F.broadcast(every) if places <= 500_000 else every
    out = given.join(every, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    spans = F.coalesce(F.col("s"), F.array().cast("array<struct<start: bigint, k: int, end: bigint, share: double>>"))
    base_only = F.filter(spans, lambda s: s["k"] <= len(KINDS))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = out.select(F.col("doc").alias("doc_id"), *[zero(f"n_{k}") for k in (*KINDS, "term")], _text_of(base_only).alias("base"), _text_of(spans).alias("spans"), "text", F.col("s"))
    mark = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def put(state: Column, s: Column) -> Column:
        said = F.when(F.coalesce(s["share"], F.lit(0.0)) >= removal, F.lit("")).otherwise(F.element_at(mark, s["k"]))
        between = F.substring(F.col("text"), state["at"].cast("int") + 1, (s["start"] - state["at"]).cast("int"))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(F.concat(state["done"], between, said).alias("done"), s["end"].alias("at")))

    made = F.aggregate("s", start, put, lambda state: F.concat(state["done"], F.substring(F.col("text"), state["at"].cast("int") + 1, F.length("text"))))
    return out.withColumn("sanitised", F.when(F.col("s").isNull(), F.col("text")).otherwise(made)).drop("s")
