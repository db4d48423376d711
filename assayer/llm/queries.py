"""The queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, chat, collocations, decontam, lines, merkle, minhash, perplexity, pii, quality_rules, substring, toxicity, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.format_chains(given))
    return read.select(F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id"), *read.columns[1:])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = ["n_email", "n_ip", "n_card", "n_phone", "n_term"]
    return found.select("doc_id", *counts, (F.col("spans") != "").alias("personal"), F.sha2("base", 256).alias("base_sha256"), "spans", F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80).drop("class_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.grades_of(_table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", "severity", "p_toxic", (F.col("p_toxic") >= toxicity.REJECT).alias("toxic"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"), run=15).drop("mark")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.remove_repeats(docs.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long")))
    n_removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
    return out.select("doc_id", F.when(F.col("text").isNotNull(), F.col("n_lines")).alias("n_lines"), n_removed.alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexity.judge(docs, _table(spark, sf_dir, "labels").where("quality = 1"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=5, percent=80)


def op10_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_pairs(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(_table(spark, sf_dir, "conversations")).drop("a", "b")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(_table(spark, sf_dir, "documents"), max_n=4, least=30, covered=80, limit=2000)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_pii": op2_pii,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_toxicity": op5_toxicity,
        "op6_passage_dedup": op6_passage_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_perplexity": op8_quality_perplexity,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_merkle_fingerprint": op10_merkle_fingerprint,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_phrase_collocations": op12_phrase_collocations,
        "op13_quality_rules": op13_quality_rules,
    }


#: Lower-case A-Z, cut at ASCII white space: the words of a text in DuckDB.
WORDS = r"list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP9 = f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
     b AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
     k AS (SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE len(w) > 0),
     ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM d, k),
     bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i+least(5, len(w))-1], ' '))) AS s FROM b WHERE len(w) > 0),
     n AS (SELECT item_id, CAST(count(*) AS BIGINT) AS n_item FROM bs GROUP BY item_id),
     x AS (SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared FROM x JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""


OP3 = f"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
     l AS (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 80 * (a.n + b.n - c)),
     e AS (SELECT i, j FROM l UNION SELECT j, i FROM l),
     r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.j, r.c FROM r JOIN e ON e.i = r.doc_id WHERE r.c < e.j),
     m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

OP7 = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
     e AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM l),
     w AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) AS n FROM w
           WHERE z IS NOT NULL AND trim(translate(x || y || z, chr(9) || chr(13), '  ')) <> ''),
     gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r WHERE n > 1),
     k AS (SELECT doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (gone.i IS NULL), '') AS t
           FROM e LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(t) AS text_sha256 FROM k
"""

#: The digests of the contract straight from the rows; formatted_chars counts the template's marks and escapes.
OP1 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     n AS (SELECT *, CAST(20 + length(regexp_replace(role, '\\\\|<s>|</s>|\\[INST\\]|\\[/INST\\]', '\\0#', 'g')) + length(regexp_replace(text, '\\\\|<s>|</s>|\\[INST\\]|\\[/INST\\]', '\\0#', 'g')) AS BIGINT) AS size FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


#: The remainders of CRC-32 are made from its polynomial; a sequence of turns is a list of digests.
OP11 = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
     k AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS k FROM range(256) r(i)),
     h AS (SELECT c, c % 20 = 0 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda x, y: xor(k[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 4 AS h
           FROM (SELECT DISTINCT c FROM t), k),
     n AS (SELECT c AS family, count(*) AS n FROM t GROUP BY c),
     r AS (SELECT h.c, p AS d, role, text FROM h JOIN t ON t.c = h.c - h.c % 20 WHERE p <= h AND NOT base
           UNION ALL SELECT t.c, CASE WHEN base THEN p ELSE p - h + least(h, coalesce(n, 0)) END, role, text FROM t JOIN h USING (c) LEFT JOIN n ON family = c - c % 20 WHERE base OR p > h),
     a AS (SELECT c, 0 AS d, CAST([] AS VARCHAR[]) AS x, 0 AS words FROM h
           UNION ALL SELECT c, d, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d), len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda z: z <> '')) FROM r),
     g AS (SELECT x, d, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM a GROUP BY x, d),
     ch AS (SELECT x[1:d-1] AS x, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
     m AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN ch ON ch.x = g.x),
     s AS (SELECT x[1:i] AS x, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM m) GROUP BY ALL),
     e AS (SELECT x, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY x)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM m JOIN s ON s.x = m.x LEFT JOIN g u ON m.d > 0 AND u.x = m.x[1:m.d-1] LEFT JOIN e ON e.x = m.x
"""

OP12 = r"""
WITH w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
         SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
     e AS (SELECT lang, p, unnest(w) AS x, unnest(range(len(w))) AS i FROM (SELECT lang, w, row_number() OVER () AS p FROM w)),
     s AS (SELECT lang, x AS x1, lead(x, 1) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4 FROM e WINDOW o AS (PARTITION BY p ORDER BY i)),
     g AS (SELECT lang, 1 AS k, x1 AS phrase FROM s UNION ALL SELECT lang, 2, x1 || ' ' || x2 FROM s WHERE x2 IS NOT NULL
           UNION ALL SELECT lang, 3, x1 || ' ' || x2 || ' ' || x3 FROM s WHERE x3 IS NOT NULL UNION ALL SELECT lang, 4, x1 || ' ' || x2 || ' ' || x3 || ' ' || x4 FROM s WHERE x4 IS NOT NULL),
     f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS a, string_split(phrase, ' ') AS x FROM g GROUP BY ALL HAVING count(*) >= 30),
     n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
     c AS (SELECT f.lang, f.k, f.phrase, f.a, f.x, j, p.a AS l, s.a AS r, CAST((CAST(2000000 AS HUGEINT) * f.a) // (CAST(p.a AS HUGEINT) + s.a) AS BIGINT) AS score
           FROM f JOIN (SELECT unnest([1, 2, 3]) AS j) ON j < f.k
           JOIN f p ON p.lang = f.lang AND p.phrase = array_to_string(f.x[1:j], ' ') JOIN f s ON s.lang = f.lang AND s.phrase = array_to_string(f.x[j+1:f.k], ' ')),
     b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
     i AS (SELECT lang, a, k, unnest(list_transform([z for z in [[1, k - 1], [2, k], [1, k - 2], [2, k - 1], [3, k]] if z[2] - z[1] > 0], lambda z: array_to_string(x[z[1]:z[2]], ' '))) AS phrase FROM f WHERE k > 2),
     o AS (SELECT lang, phrase, max(a) AS more FROM i GROUP BY ALL),
     t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, phrase) AS rank FROM b LEFT JOIN o USING (lang, phrase) WHERE o.more IS NULL OR 100 * o.more < 80 * b.a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""


OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS host, coalesce('t' || text, '') AS digest, coalesce(text, '') AS t FROM documents),
     l AS (SELECT r, host, digest, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
     v AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+'), lambda z: z <> '') AS w,
                  row_number() OVER (PARTITION BY r, x ORDER BY i) AS k FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
     p AS (SELECT r, x, i, generate_subscripts(c, 1) AS j, unnest(c) AS c FROM (SELECT r, x, i, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda z: z <> '') AS c FROM v)),
     n AS (SELECT r, row_number() OVER o AS j, c AS x, lead(c, 1) OVER o AS y, lead(c, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY r ORDER BY i, j)),
     q AS (SELECT r, j, z IS NOT NULL AND count(*) OVER (PARTITION BY r, x, y, z) > 1 AS again FROM n),
     s AS (SELECT r, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS covered FROM q WINDOW o AS (PARTITION BY r ORDER BY j)),
     rw AS (SELECT r, count(*) FILTER (covered) AS n_repeat_words FROM s GROUP BY r),
     f AS (SELECT host, w FROM v GROUP BY ALL HAVING count(DISTINCT digest) > 10 AND 100 * count(DISTINCT digest) > 5 * max((SELECT count(DISTINCT digest) FROM d WHERE d.host = v.host))),
     a AS (SELECT r, sum(len(v.w)) AS n_words, sum(list_sum(list_transform(v.w, lambda z: length(z)))) AS word_chars, count(*) FILTER (k > 1) AS n_dup_lines, coalesce(sum(len(v.w)) FILTER (f.w IS NOT NULL), 0) AS gone
           FROM v LEFT JOIN f ON f.host = v.host AND f.w = v.w GROUP BY r),
     o AS (SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_frequent_words FROM d LEFT JOIN a USING (r) LEFT JOIN rw USING (r)),
     b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND 100 * (n_words - n_frequent_words) >= 50 * n_words AS kept FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": OP1,
        "op3_minhash_dedup": OP3,
        "op7_line_dedup": OP7,
        "op9_benchmark_decontamination": OP9,
        "op11_prefix_trie": OP11,
        "op12_phrase_collocations": OP12,
        "op13_quality_rules": OP13,
    }
