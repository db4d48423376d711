from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayer.functions import digests, flags, urls, wire
from assayer.sources.documents import TAXONOMY


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_spans_offsets_exemptions_and_limits(spark):
    c = {"id": "n", "pattern": "[0-9]+", "unless": ["^7"]}
    text = "é 12 x 7 y 345 z 6 😀 89"
    got = one(spark, flags.spans(F.col("t"), c, 3), t=text)
    assert [(s["start"], s["end"], s["text"]) for s in got] == [(2, 4, "12"), (11, 14, "345"), (17, 18, "6")]
    for s in got:
        assert text[s["start"] : s["end"]] == s["text"]
    long = one(spark, flags.spans(F.col("t"), {"id": "a", "pattern": "a+"}), t="a" * 300)[0]
    assert long["text"] == "a" * 200 + "..." and long["end"] == 300


def test_flags_one_for_each_type_with_the_criteria_that_fired(spark):
    got = one(spark, flags.flags(F.col("t"), TAXONOMY, evidence=True), t="mail Me@x.example or +1 (555) 123-4567, host 127.0.0.1")
    assert [(f["type"], f["severity"], f["basis"]) for f in got] == [("contact_detail", 2, "own-1:email+phone")]
    assert len(got[0]["evidence"]) == 2


def test_a_sunset_taxonomy_is_refused():
    with pytest.raises(ValueError):
        flags.admissible({"status": "sunset"})


@pytest.mark.parametrize("text", ["no object", "{broken", '{"flags": 3}', "}{"])
def test_unreadable_model_verdicts_give_no_flags(spark, text):
    assert one(spark, flags.model_flags(F.col("v"), F.lit("abc"), TAXONOMY), v=text) == []


@pytest.mark.parametrize(
    ("base", "contacted", "ok"),
    [
        ("https://a.example/v1", "https://a.example/v1/chat", True), ("https://a.example/v1", "https://a.example:443/v1", True), ("https://a.example/v1/", "https://A.example/v1?x=1", True),
        ("https://a.example/v1", "https://a.example/v1evil", False), ("https://a.example/v1", "http://a.example/v1", False), ("https://a.example/v1", "https://a.example:8443/v1", False),
        ("https://a.example/v1", "https://u:p@a.example/v1", False), ("nonsense", "https://a.example/v1", False), ("https://a.example", "https://a.example.evil/", False),
    ],
)
def test_endpoints(spark, base, contacted, ok):
    assert one(spark, urls.endpoint_matches(F.col("a"), F.col("b")), a=base, b=contacted) is ok


def test_strict_json(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ('{"x": {"b": 1, "b": 1}}',), ('{"a": 1} x',), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(wire.json_code(F.col("t"))).collect()] == ["ok", "duplicate", "duplicate", "malformed", "malformed", "malformed"]


def test_seal_and_open_round_trip(spark):
    key = "0123456789abcdef"
    text = "a secret with ü"
    # Each evaluation draws its own nonce, so the sealed text is taken out before it is read.
    kept = one(spark, digests.sealed(F.col("t"), F.lit(key)), t=text)
    assert kept.startswith("v1.") and one(spark, digests.opened(F.col("t"), F.lit(key)), t=kept) == text
    assert one(spark, digests.opened(F.col("t"), F.lit("another key 0000")), t=kept) is None
    assert one(spark, digests.opened(F.lit("v1.AAAA.BBBB.CCCC"), F.lit(key)), t=text) is None


def test_payload_counts_bytes(spark):
    got = one(spark, digests.seal_payload("d/v1", [F.lit("a"), F.lit("b")], F.encode(F.col("t"), "UTF-8")), t="é")
    assert bytes(got) == "d/v1\na\nb\n2\n\né".encode()


def test_seal_header_decoding(spark):
    header = wire.encoded(F.struct(F.lit("e").alias("registerEntryId"), F.lit("k").alias("selector")))
    assert one(spark, wire.decoded_seal(header)["selector"]) == "k"
    assert one(spark, wire.decoded_seal(F.lit("%%%"))) is None


def test_events_of_a_body(spark):
    body = 'data: {"a":1}\r\n\r\nevent: seal\ndata: xyz\n\n: comment\n\ndata: [DONE]\n\ndata: not json\n\nevent: pre-seal\ndata: p\n\ndata: {"b":\ndata: 2}'
    got = [(e["kind"], e["value"]) for e in one(spark, wire.events(F.col("t")), t=body)]
    assert got == [("data", '{"a":1}'), ("terminal-seal", "xyz"), ("pre-seal", "p"), ("data", '{"b":\n2}')]


def test_bindings_take_strings_only(spark):
    bind = lambda name, text: one(spark, wire.BINDINGS[name](F.try_parse_json(F.col("t"))), t=text)
    assert bind("chat-delta", '{"choices":[{"delta":{"content":" x"}}]}') == " x"
    assert bind("chat-delta", '{"choices":[{"delta":{"content":5}}]}') == ""
    assert bind("content-block-delta", '{"type":"content_block_delta","delta":{"type":"text_delta","text":"y"}}') == "y"
    assert bind("content-block-delta", '{"type":"other","delta":{"type":"text_delta","text":"y"}}') == ""


def test_only_one_record_of_the_version(spark):
    rec = lambda *r: F.array(*[F.array(*[F.lit(x) for x in p]) for p in r])
    assert one(spark, wire.select_txt(rec(["v=b1; ", "e=x"], ["spf"]), "b1"))["entry_id"] == "x"
    assert one(spark, wire.select_txt(rec(["v=b1;e=x"], ["v=b1;e=y"]), "b1"))["reason"] == "several_records"
    assert one(spark, wire.select_txt(rec(["other"]), "b1"))["ok"] is False


#: Test 2 of RFC 8032, section 7.1; fixed values.
KEY = "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
MESSAGE = "72"
SIGNATURE = "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"


def test_signatures(spark, tmp_path):
    import base64

    from assayer.functions import ed25519
    from assayer.sources import documents

    key, message, signature = map(bytes.fromhex, (KEY, MESSAGE, SIGNATURE))
    assert ed25519.verify(key, message, signature)
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    assert ed25519.public_key(seed) == key and ed25519.sign(seed, message) == signature
    assert all(ed25519.verify(key, m, ed25519.sign(seed, m)) for m in (b"", b"x" * 1000, bytes(range(256))))
    assert not ed25519.verify(key, b"s", signature) and not ed25519.verify(key, message, signature[:63] + b"\x10") and not ed25519.verify(b"", message, signature)
    pem = "-----BEGIN PUBLIC KEY-----\n" + base64.b64encode(ed25519._SPKI + key).decode() + "\n-----END PUBLIC KEY-----\n"
    text = base64.urlsafe_b64encode(signature).decode().rstrip("=")
    rows = spark.createDataFrame([(pem, "r", text), (pem, "x", text), ("no key", "r", text), (None, "r", text)], "pem string, m string, s string")
    assert [r[0] for r in rows.select(ed25519.signature_valid(F.col("pem"), F.col("m"), F.col("s"))).collect()] == [True, False, False, False]
    for name, body in (("d", '{"a": 1}'), ("s", text), ("k", pem)):
        (tmp_path / name).write_text(body)
    assert documents.read_signed(spark, str(tmp_path / "d"), str(tmp_path / "s"), str(tmp_path / "k")) == ({"a": 1}, False)


def test_signing_is_dealt_to_all_cores(spark, tmp_path):
    """A small table in one file, and a batch of many providers, are signed and checked by more than one task."""
    from assayer.functions import ed25519
    from assayer.operators import scoring
    from assayer.plans import queries

    rows = spark.range(200).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"), (F.col("id") % 25).cast("int").alias("s_nationkey"))
    rows.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    tasks = lambda df: df.select(F.spark_partition_id().alias("p"), "*").where("p is not null").select("p").distinct().count()
    assert tasks(queries.signed_documents(spark, str(tmp_path))) > 1
    rated = spark.range(200).select(F.concat(F.lit("p"), "id").alias("provider_id"), F.lit("{}").alias("payload"), F.lit("no").alias("signature"))
    head = spark.createDataFrame([(None, "{}", "no")], "provider_id string, payload string, signature string")
    batch = rated.union(head).coalesce(1)
    assert tasks(scoring.checked_batch(batch, ed25519.pem_of(bytes.fromhex(KEY)))) > 1


def test_a_key_met_again_is_not_doubled_again(monkeypatch):
    """A second signature, and a second check by one key, take an addition a digit; both halves of a signature and odd keys are judged as before."""
    from assayer.functions import ed25519

    seed = bytes(range(1, 33))
    key, calls = ed25519.public_key(seed), []
    for i in range(40):
        assert ed25519.verify(key, b"%d" % i, ed25519.sign(seed, b"%d" % i))
    plain = ed25519._add
    monkeypatch.setattr(ed25519, "_add", lambda a, b: calls.append(1) or plain(a, b))
    signature = ed25519.sign(seed, b"again")
    assert len(calls) < 100
    assert ed25519.verify(key, b"again", signature) and len(calls) < 300
    # A first half above the prime, and the identity as key and first half with a scalar of 0.
    assert not ed25519.verify(key, b"again", (ed25519._P + 1).to_bytes(32, "little") + signature[32:])
    one = (1).to_bytes(32, "little")
    assert ed25519.verify(one, b"m", one + bytes(32)) and not ed25519.verify(one, b"m", (ed25519._P + 1).to_bytes(32, "little") + bytes(32))


def test_chunks_are_dealt_by_their_bytes(spark):
    """A task sorts some 64 MB of chunks: 370 MB go to more tasks than the session's four; 40 GB to no more than are dealt without a sort."""
    assert [wire._shares(n) for n in (0, 1 << 29, 40 << 30, 200 << 30)] == [0, 8, 200, 400]
    i = F.col("id")
    chunks = spark.range(1_500_000).select((i % 5000).alias("exchange_id"), F.floor(i / 5000).alias("chunk_no"), F.expr("cast(repeat('x', 150) as binary)").alias("chunk"))
    sizes = wire.whole_chunks(chunks).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("size")).collect()
    assert len(sizes) == 5 and sum(r["n"] for r in sizes) == 5000 and sum(r["size"] for r in sizes) == 225_000_000


def test_chunks_of_odd_keys(spark):
    """No key is a key, a null chunk is empty, equal numbers go by their bytes, a character may be cut; batches of two rows change nothing."""
    rows = [(None, 1, b"b"), (None, 0, b"a"), ("k", 1, b"\xa9"), ("k", 0, b"\xc3"), ("k", 2, None), ("k", None, b"0"), ("d", 5, b"y"), ("d", 5, b"x"), ("e", 0, b""), ("bad", 0, b"\xff")]
    chunks = spark.createDataFrame([(k, n, c and bytearray(c)) for k, n, c in rows], "exchange_id string, chunk_no int, chunk binary")
    want = {None: "ab", "k": "0é", "d": "xy", "e": "", "bad": "\ufffd"}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("2", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            assert all({r[0]: r[1] for r in wire.whole_chunks(chunks, parts=parts).collect()} == want for parts in (None, 1, 3))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bodies_are_read_where_they_lie(spark):
    """Neither a shuffle nor a window: no task sorts the events of other bodies."""
    data, seal = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\n', "event: seal\ndata: %s\n\n"
    bodies = {"plain": data * 2, "none": None, "late": data + seal % 1 + data, "first": seal % 1, "twice": data + seal % 1 + seal % 2, "pre": "event: pre-seal\ndata: p\n\n" + data}
    out = wire.accumulated(spark.createDataFrame(list(bodies.items()), "exchange_id string, body string"), "chat-delta")
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {
        "plain": ("aa", None, False, False), "none": ("", None, False, False), "late": ("a", "1", True, False),
        "first": ("", "1", False, False), "twice": ("a", "2", False, True), "pre": ("a", None, False, False),
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_scripted_deltas_read_back(spark):
    from assayer.operators import views

    rows = spark.createDataFrame([("x", ' one\n"two"  é')], "exchange_id string, text string")
    got = wire.accumulated(wire.whole_chunks(views.scripted_deltas(rows)), "chat-delta").first()
    assert got["sealed_content"] == ' one\n"two"  é' and got["terminal_seal"] is None


def test_strict_json_in_columns(spark):
    """Against a plain reader, on sound texts, cut and glued ones, repeats at any depth, escapes and odd numbers."""
    import json
    import random

    def plain(text):
        seen = []

        def pairs(found):
            seen.append(len({k for k, _ in found}) < len(found))
            return dict(found)

        try:
            json.loads(text, object_pairs_hook=pairs, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        except (ValueError, TypeError):
            return "malformed"
        return "duplicate" if any(seen) else "ok"

    rng = random.Random(9)
    names = ["a", "b", "A", "", "k", "\\u0061", "é", "\\n", '\\"']

    def value(depth):
        kind = rng.randint(0, 7 if depth else 4)
        if kind == 5:
            return "[" + rng.choice([",", ", "]).join(value(depth - 1) for _ in range(rng.randint(0, 3))) + "]"
        if kind > 5:
            return "{" + ",".join(f'"{rng.choice(names)}": {value(depth - 1)}' for _ in range(rng.randint(0, 3))) + "}"
        return rng.choice(["1", "-0", "1e5", "0.5", "null", "true", '"x"', '"\\ud83d\\ude00"', '"\\\\"', "123456789012345678901234567890", '"}"', '"],["'])

    texts = [value(3) for _ in range(700)]
    texts += [t[: rng.randint(0, len(t))] for t in texts[:200]] + [a + rng.choice(["", " ", ",", "}", "]", "],[", '}{"k":', "\n", ':1,"k":']) + b for a, b in zip(texts[200:400], texts[400:600])]
    texts += ["", " ", "\t1\n", "NaN", "[NaN]", "Infinity", "01", "1.", ".5", "+1", "'a'", "{'a': 1}", '{"a": 1,}', "[1,]", "1 2", "1,2", "1],[2", '1}{"k":2', '"a\nb"', '"\\x"', "// c\n1", "﻿1", None, "[" * 300 + "]" * 300, '{"a":{"b":1,"b":2}}x', "tru", '"open', "1:2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    plan = rows.select(wire.json_code(F.col("t")).alias("code"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: r["code"] for r in rows.select("i", wire.json_code(F.col("t")).alias("code")).collect()}
    wrong = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not wrong and set(got.values()) == {"ok", "duplicate", "malformed"}


def test_txt_faults_go_tag_by_tag(spark):
    reason = lambda t: one(spark, wire.txt_binding(F.col("t"), "b1")["reason"], t=t)
    assert [reason(t) for t in ("e=one;nonsense", "v=b1;nonsense;e=a;e=b", "v=b1;e=a;e=b;nonsense", "nonsense", "v=b1;v=b1", ";", "v=b1;=x")] == ["version_not_first", "bad_tag", "repeated_tag", "bad_tag", "repeated_tag", "empty", "bad_tag"]
