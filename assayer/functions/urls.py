"""URL predicates: structural endpoint matching, forbidden hosts, page URL parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#@:\[\]\s]+)(?::([0-9]*))?([^?#]*)(?:\?[^#]*)?(?:#.*)?$"


def _group(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, n)


def valid(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(_URL), F.lit(False))


def host(url: Column) -> Column:
    return F.lower(_group(url, 3))


def origin(url: Column) -> Column:
    """Scheme, host and port, the scheme's own port left out; null for what is no URL."""
    scheme, port = F.lower(_group(url, 1)), _group(url, 4)
    usual = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")) | (port == "")
    return F.when(valid(url), F.concat(scheme, F.lit("://"), host(url), F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port))))


def path(url: Column) -> Column:
    """The path without slashes at its end."""
    return F.regexp_replace(_group(url, 5), "/+$", "")


def has_credentials(url: Column) -> Column:
    return _group(url, 2) != ""


_CUT = "\x01"


def _parts(url: Column) -> Column:
    """(scheme, credentials, host, port, path) by one match; an array of another size for what is no URL."""
    text = F.trim(url)
    return F.when(~text.contains(_CUT), F.split(F.regexp_replace(text, _URL, _CUT.join(f"${i}" for i in range(1, 6))), _CUT))


def _same(base: Column, own: Column) -> Column:
    """Same origin, and a path that is the base's or goes on from it after a slash; never with credentials."""
    part = lambda p, i: F.get(p, F.lit(i))
    port = lambda p: F.when(part(p, 3) != "", part(p, 3)).when(F.lower(part(p, 0)) == "https", "443").when(F.lower(part(p, 0)) == "http", "80").otherwise("")
    path_of = lambda p: F.regexp_replace(part(p, 4), "/+$", "")
    sound = (F.size(base) == 5) & (F.size(own) == 5) & (part(base, 1) == "") & (part(own, 1) == "")
    origins = (F.lower(part(base, 0)) == F.lower(part(own, 0))) & (F.lower(part(base, 2)) == F.lower(part(own, 2))) & (port(base) == port(own))
    return sound & origins & ((path_of(own) == path_of(base)) | path_of(own).startswith(F.concat(path_of(base), F.lit("/"))))


def endpoint_matches(base: Column, contacted: Column) -> Column:
    return endpoint_authorized(F.array(base), contacted)


def endpoint_authorized(endpoints: Column, contacted: Column) -> Column:
    """Whether any endpoint is the contacted URL's; each URL is matched once, as a lambda's variable is computed once."""
    either = lambda own: F.exists(F.transform(endpoints, _parts), lambda base: F.coalesce(_same(base, own), F.lit(False)))
    return F.coalesce(F.get(F.transform(F.array(_parts(contacted)), either), F.lit(0)), F.lit(False))


def forbidden_host(name: Column) -> Column:
    """Loopback, private and link-local names and addresses."""
    h = F.lower(F.regexp_replace(name, r"^\[|\]$", ""))
    v4 = h.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")
    part = lambda i: F.get(F.split(h, r"\."), F.lit(i)).try_cast("int")
    private4 = part(0).isin(10, 127, 0) | ((part(0) == 169) & (part(1) == 254)) | ((part(0) == 172) & part(1).between(16, 31)) | ((part(0) == 192) & (part(1) == 168))
    v6 = h.contains(":")
    private6 = (h == "::1") | h.startswith("fc") | h.startswith("fd") | h.startswith("fe80:")
    return F.coalesce((h == "localhost") | h.endswith(".localhost") | F.when(v4, private4).when(v6, private6).otherwise(F.lit(False)), F.lit(False))


def loopback(url: Column) -> Column:
    return F.coalesce(host(url).isin("localhost", "127.0.0.1", "::1", "[::1]"), F.lit(False))


def outbound_paths(base: Column) -> Column:
    """Origins that response content leaves for when it is evaluated at ``base``: none on the loopback interface."""
    return F.when(loopback(base) | ~valid(base), F.array().cast("array<string>")).otherwise(F.array(origin(base)))


def basename(name: Column) -> Column:
    return F.element_at(F.split(name, r"[/\\]"), -1)
