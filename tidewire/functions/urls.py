"""Canonical URLs: exact in an Arrow UDF, and the JVM-side form for plain queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query keys that carry tracking alone, and prefixes of such keys.
TRACKING = (
    "fbclid", "gclid", "dclid", "msclkid", "igshid", "mkt_tok", "ref", "referrer", "source", "spm", "s_kwcid", "_ga", "yclid", "twclid", "cmpid", "ncid", "smid", "partner",
)
TRACKING_PREFIXES = ("utm_", "pk_", "mc_", "hsa_", "ga_")
PORTS = {"http": 80, "https": 443}


def canonical(url: str) -> str:
    """The form that two addresses of one article share; needs no network."""
    from urllib import parse

    u = parse.urlsplit(url.strip())
    scheme, where = u.scheme.lower(), (u.hostname or "").rstrip(".")
    if u.port and u.port != PORTS.get(scheme):
        where += f":{u.port}"
    pairs = sorted(p for p in parse.parse_qsl(u.query, keep_blank_values=True) if not _tracks(p[0].lower()))
    path = (u.path.rstrip("/") or "/") if len(u.path) > 1 else "/"
    if set(u.path) == {"/"} and len(u.path) > 1:
        path = ""
    return parse.urlunsplit((scheme, where, path, parse.urlencode(pairs), ""))


def _tracks(key: str) -> bool:
    return key in TRACKING or key.startswith(TRACKING_PREFIXES)


@F.pandas_udf(T.StringType())
def canonical_url(urls: pd.Series) -> pd.Series:
    """canonical() of each URL; null where the URL is null or can't be split."""

    def one(u):
        try:
            return None if u is None else canonical(u)
        except ValueError:
            return None

    return urls.map(one)


def canonical_url_native(url: Column) -> Column:
    """The same without percent-decoding: for URLs whose query needs none."""
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    where = F.regexp_replace(F.lower(F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.+$", "")
    port = F.regexp_extract(url, r"://[^/?#]*:(\d+)", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), "/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")

    def stays(p: Column) -> Column:
        key = F.lower(F.split_part(p, F.lit("="), F.lit(1)))
        return ~(key.isin(*TRACKING) | key.rlike("^(" + "|".join(TRACKING_PREFIXES) + ")"))

    query = F.array_join(F.array_sort(F.filter(pairs, stays)), "&")
    return F.concat(scheme, F.lit("://"), where, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
