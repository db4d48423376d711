"""Digests, canonical payloads and sealed text, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    """Bytes of unpadded base64url; null where it isn't."""
    return F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))


def request_digest(request: Column) -> Column:
    return F.concat(F.lit("sha-256="), base64url(F.unhex(F.sha2(request, 256))))


def fixed4(number: Column) -> Column:
    return number.cast("decimal(18,4)").cast("string")


def pem_body(pem: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(pem, "-----[A-Z ]+-----", ""), r"[ \n\r\t]", "")


def key_set_digest(keys: Column) -> Column:
    """Of (selector, publicKeyPem, ...): selector and body on lines of their own, by selector in byte order."""
    rows = F.array_sort(F.transform(keys, lambda k: F.struct(k["selector"].alias("s"), pem_body(k["publicKeyPem"]).alias("b"))))
    material = F.array_join(F.transform(rows, lambda r: F.concat(r["s"], F.lit("\n"), r["b"], F.lit("\n"))), "")
    return base64url(F.unhex(F.sha2(material, 256)))


def flag_text(flags: Column) -> Column:
    return F.array_join(F.transform(flags, lambda f: F.concat_ws(":", f["type"], f["severity"].cast("string"), f["evidence_ref"])), ",")


def entry_hash(domain: str, prev_hash: Column) -> Column:
    """Hash of a ledger row after ``prev_hash``; the domain line keeps ledgers of other formats apart."""
    return F.sha2(F.concat_ws("\n", F.lit(domain), "provider_id", F.col("seq").cast("string"), "response_id", "at_iso", "outcome", fixed4(F.col("score")), flag_text(F.col("flags")), prev_hash), 256)


def seal_payload(domain: str, fields: list[Column], content: Column) -> Column:
    """Header lines, one of them the number of content bytes, a blank line, then the content's bytes."""
    head = F.concat_ws("\n", F.lit(domain), *fields, F.octet_length(content).cast("string"))
    return F.concat(F.encode(F.concat(head, F.lit("\n\n")), "UTF-8"), content.cast("binary"))


def pre_seal_payload(domain: str, fields: list[Column]) -> Column:
    return F.encode(F.concat_ws("\n", F.lit(domain), *fields), "UTF-8")


def one_line(field: Column) -> Column:
    """Whether a seal field may stand on a line."""
    return ~F.coalesce(field, F.lit("")).rlike("[\r\n]")


def sealed(text: Column, key: Column) -> Column:
    """AES-GCM as ``v1.iv.tag.ciphertext`` in base64url."""

    def packed(raw: Column) -> Column:
        size = F.octet_length(raw)
        part = lambda at, n: base64url(F.call_function("substring", raw, at, n))
        return F.concat_ws(".", F.lit("v1"), part(F.lit(1), F.lit(12)), part(size - 15, F.lit(16)), part(F.lit(13), size - 28))

    # A lambda's variable holds one encryption; a repeated expression would draw a nonce each time.
    return F.get(F.transform(F.array(F.aes_encrypt(text, key, F.lit("GCM"))), packed), F.lit(0))


def opened(text: Column, key: Column) -> Column:
    """Text of ``sealed``; null where it was changed or the key is another."""
    p = F.split(text, r"\.")
    raw = F.concat(from_base64url(F.get(p, F.lit(1))), from_base64url(F.get(p, F.lit(3))), from_base64url(F.get(p, F.lit(2))))
    return F.when(F.get(p, F.lit(0)) == "v1", F.try_aes_decrypt(raw, key, F.lit("GCM")).cast("string"))
