"""URL expressions: canonical form, domain, legacy hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.functions.text import strip

# Query parameters that only track.
TRACKING_PARAMETERS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "referrer")


def domain(url: Column) -> Column:
    """Lower-case authority, every "www." removed; empty for a null or relative URL."""
    return F.coalesce(F.replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("www.")), F.lit(""))


def _encoded(part: Column) -> Column:
    """A form value decoded and encoded again; Java keeps * and escapes ~, the form standard in use here does the reverse."""
    return F.replace(F.replace(F.url_encode(F.url_decode(part)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, default ports, tracking parameters and fragment dropped, an empty path as /."""
    u = strip(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host_port = F.lower(F.regexp_extract(authority, r"([^@]*)$", 1))
    port = F.regexp_extract(host_port, r":([0-9]+)$", 1)
    host = F.regexp_replace(host_port, r":[0-9]*$", "")
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")) | (port == "")
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    key = lambda p: F.lower(F.url_decode(F.regexp_extract(p, "^([^=]*)", 1)))
    kept = F.filter(pairs, lambda p: ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING_PARAMETERS))
    again = F.transform(kept, lambda p: F.concat(_encoded(F.regexp_extract(p, "^([^=]*)", 1)), F.lit("="), _encoded(F.regexp_extract(p, "=(.*)$", 1))))
    tail = F.when(F.size(again) > 0, F.concat(F.lit("?"), F.array_join(again, "&"))).otherwise("")
    return F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), tail)


def url_hash(url: Column) -> Column:
    """Hash of domain and path, lower case; empty for an empty URL."""
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.sha2(F.concat(domain(url), path), 256))


def title_hash(title: Column) -> Column:
    """Hash of the title without punctuation, lower case, spaces collapsed; empty for an empty title."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))
    return F.when(F.coalesce(title, F.lit("")) == "", "").otherwise(F.sha2(bare, 256))


def iso_time(ts: Column) -> Column:
    """ISO time, microseconds only where there are any."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))
