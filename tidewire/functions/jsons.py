"""JSON that Spark's own functions can't rewrite."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def masked(value, keys: frozenset[str]):
    """value with `*` for what stands under one of the keys, at any depth; keys in order."""
    if isinstance(value, dict):
        return {k: "*" if k in keys else masked(v, keys) for k, v in sorted(value.items())}
    return [masked(v, keys) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def mask_keys(raw: pd.Series, keys: pd.Series) -> pd.Series:
    """Each document compact, its keys in order, those named in `keys` (comma-separated) masked; null where it is no JSON."""

    def one(doc: str, names: str) -> str | None:
        try:
            return json.dumps(masked(json.loads(doc), frozenset(names.split(","))), separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return pd.Series([one(d, k) for d, k in zip(raw, keys, strict=True)], dtype=object)


#: Made once: json.dumps with options makes an encoder for each call.
_compact = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def _leaves(value, path: str, key: str):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}", key)
    elif isinstance(value, list) and value:
        names = [v.get(key) if isinstance(v, dict) else None for v in value]
        # Elements that all have a name of their own go by it, others by their place.
        named = key and None not in names and len(set(map(repr, names))) == len(names)
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}[{key}={names[i]}]" if named else f"{path}[{i}]", key)
    else:
        yield path, _compact(value)


def leaves(doc: str | None, key: str, volatile: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """The leaves of a document as paths and compact values, read once; empty objects and lists are leaves.

    Elements of a list are named by their place, or, where all are objects with their own value of
    `key`, by that: then their order doesn't count. What stands under a key of `volatile` is masked first.
    A document that is no JSON is one leaf, `$text`; null has none.
    """
    if doc is None:
        return []
    try:
        value = json.loads(doc)
        return list(_leaves(masked(value, volatile) if volatile else value, "$", key))
    except ValueError:
        return [("$text", doc)]
