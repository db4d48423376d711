"""Taxonomy scanning: one projection, no row explosion.

Whatever the number of criteria, a text is searched once for the literals that their matches must hold, and
only criteria with one of theirs in it are matched.  Patterns that begin with a run of characters are matched in a form that takes time
in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions import patterns

#: Up to this many literals are looked for one by one, more of them in one pass.
FEW = 16

MAX_SPANS, MAX_CHARS = 3, 200


def admissible(taxonomy: dict[str, Any]) -> None:
    if taxonomy.get("status") == "sunset":
        raise ValueError(f"taxonomy {taxonomy.get('taxonomyVersion')} is past its sunset")


def _pattern(criterion: dict[str, Any]) -> str:
    flags = criterion.get("flags", "gi")
    inline = "".join(f for f in "ims" if f in flags)
    return (f"(?{inline})" if inline else "") + patterns.linear(criterion["pattern"])


def _exempt(match: Column, criterion: dict[str, Any]) -> Column:
    """Exemptions are tested on the matched text only."""
    found = F.lit(False)
    for pattern in criterion["unless"]:
        found = found | match.rlike("(?i)" + pattern)
    return found


def spans(text: Column, criterion: dict[str, Any], most: int | None = None) -> Column:
    """Matches that are not exempt, with offsets in code points; the first ``most`` of them."""
    pattern = F.lit(_pattern(criterion))
    matches, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, _pattern(criterion), -1)
    rows = F.transform(matches, lambda m, i: F.struct(i.alias("i"), m.alias("m")))
    kept = F.filter(rows, lambda r: r["m"] != "")
    if criterion.get("unless"):
        kept = F.filter(kept, lambda r: ~_exempt(r["m"], criterion))
    if most is not None:
        kept = F.slice(kept, 1, most)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    start = lambda r: total(F.slice(pieces, 1, r["i"] + 1)) + total(F.slice(matches, 1, r["i"]))
    short = lambda m: F.when(F.length(m) > MAX_CHARS, F.concat(F.substring(m, 1, MAX_CHARS), F.lit("..."))).otherwise(m)
    return F.transform(kept, lambda r: F.struct(start(r).alias("start"), (start(r) + F.length(r["m"])).alias("end"), short(r["m"]).alias("text")))


def _hits(text: Column, criterion: dict[str, Any]) -> Column:
    """Whether a match stands that is neither empty nor exempt."""
    if not criterion.get("unless") and not patterns.may_be_empty(criterion["pattern"]):
        return text.rlike(_pattern(criterion))
    out = F.regexp_extract_all(text, F.lit(_pattern(criterion)), F.lit(0))
    return F.exists(out, lambda m: (m != "") & ~_exempt(m, criterion))


def _needed(criterion: dict[str, Any]) -> frozenset[str]:
    """Literals of which each match holds one: ``needs`` if it is given, else what the pattern shows."""
    return frozenset([criterion["needs"].lower()]) if criterion.get("needs") else patterns.required(criterion["pattern"], shortest=2)


def _in_sight(text: Column, taxonomy: dict[str, Any], test: Callable[[Callable[[dict[str, Any]], Column]], Column]) -> Column:
    """``test`` of a function that tells, for a criterion, whether its match may stand in the text; literals are looked for once."""
    literals = set().union(*(_needed(c) for f in taxonomy["flags"] for c in f["criteria"]))
    if len(literals) <= FEW:

        def one_by_one(c: dict[str, Any]) -> Column:
            own = [(text if x == x.upper() else F.lower(text)).contains(x) for x in sorted(_needed(c))]
            return reduce(lambda a, b: a | b, own, F.lit(False)) if own else F.lit(True)

        return test(one_by_one)
    present = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(patterns.any_of(literals)), F.lit(1)), F.lower))

    def seen(found: Column) -> Callable[[dict[str, Any]], Column]:
        def may(c: dict[str, Any]) -> Column:
            needed = _needed(c)
            # Where a longer literal stands, those it starts with do too.
            own = sorted(x for x in literals if any(x.startswith(n) for n in needed))
            return F.arrays_overlap(found, F.array(*map(F.lit, own))) if needed else F.lit(True)

        return may

    # A lambda's variable is computed once, however often it is read.
    return F.get(F.transform(F.array(present), lambda found: test(seen(found))), F.lit(0))


def flags(text: Column, taxonomy: dict[str, Any], evidence: bool = False) -> Column:
    """At most one flag of each type, in the taxonomy's order: (type, severity, basis[, evidence])."""
    admissible(taxonomy)
    version = F.lit(taxonomy["taxonomyVersion"] + ":")

    def fired(may: Callable[[dict[str, Any]], Column]) -> Column:
        ids = lambda flag: F.array_compact(F.array(*[F.when(may(c) & _hits(text, c), F.lit(c["id"])) for c in flag["criteria"]]))
        return F.array(*[F.struct(F.lit(f["type"]).alias("type"), F.lit(int(f["severity"])).alias("severity"), ids(f).alias("ids")) for f in taxonomy["flags"]])

    def shown(f: Column) -> Column:
        fields = [f["type"].alias("type"), f["severity"].alias("severity"), F.concat(version, F.array_join(f["ids"], "+")).alias("basis")]
        if evidence:
            # Only types that fired come here.
            none = F.array().cast("array<struct<start: int, end: int, text: string>>")
            places = [(flag["type"], F.slice(F.concat(*[spans(text, c, MAX_SPANS) for c in flag["criteria"]]), 1, MAX_SPANS)) for flag in taxonomy["flags"]]
            fields.append(F.coalesce(*[F.when(f["type"] == kind, found) for kind, found in places], none).alias("evidence"))
        return F.struct(*fields)

    # The criteria of a flag are tested once: both lambdas read the array.
    return F.transform(F.filter(_in_sight(text, taxonomy, fired), lambda f: F.size(f["ids"]) > 0), shown)


def instant_score(flag_array: Column) -> Column:
    return F.aggregate(flag_array, F.lit(0).cast("long"), lambda n, f: n + F.coalesce(f["severity"], F.lit(0)))


def evaluator_version(taxonomy: dict[str, Any]) -> str:
    return f"0.1.0+tax.{taxonomy['taxonomyVersion']}"


def model_flags(verdict: Column, evaluated: Column, taxonomy: dict[str, Any]) -> Column:
    """Flags of a model's verdict text: the outermost object, types of the taxonomy only, its severities,
    evidence that stands in the evaluated text; anything unreadable gives none."""
    body = F.regexp_extract(verdict, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "flags array<struct<type: string, reason: string, evidence: array<string>>>")["flags"]
    severity = F.create_map(*[x for f in taxonomy["flags"] for x in (F.lit(f["type"]), F.lit(int(f["severity"])))])
    known = F.filter(F.coalesce(parsed, F.array()), lambda f: F.array_contains(F.map_keys(severity), F.coalesce(f["type"], F.lit(""))))
    place = lambda e: F.call_function("instr", evaluated, e)
    found = lambda f: F.filter(F.transform(F.coalesce(f["evidence"], F.array().cast("array<string>")), lambda e: F.struct((place(e) - 1).alias("start"), (place(e) - 1 + F.length(e)).alias("end"), e.alias("text"))), lambda s: s["start"] >= 0)
    basis = lambda f: F.concat(F.lit(taxonomy["taxonomyVersion"] + ":model:"), F.substring(F.coalesce(f["reason"], F.lit("")), 1, 120))
    return F.transform(known, lambda f: F.struct(f["type"].alias("type"), F.element_at(severity, f["type"]).alias("severity"), basis(f).alias("basis"), found(f).alias("evidence")))


def prompt(taxonomy: dict[str, Any], content: Column) -> Column:
    """The catalogue of types and the text, for an outside evaluator."""
    lines = [f"- {f['type']} (severity {f['severity']})" for f in taxonomy["flags"]]
    return F.concat_ws("\n", F.lit("Types:"), *[F.lit(x) for x in lines], F.lit("Text:"), content)
