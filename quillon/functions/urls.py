"""URL functions."""

from __future__ import annotations

import json
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the key that names items in a fragment.
ITEM_KEYS = ("itemid", "ItemId", "ITEMID")


def normalise_url(url: str) -> str:
    """`https://<host>/<lang>?i=<first item id>` of a URL that names its items in a JSON fragment; any other URL unchanged.

    The fragment may be percent-encoded in part or whole and may lack its outer braces; lang is the first part of the path.
    """
    if "?i=" in url or "#" not in url:
        return url
    address, _, fragment = url.partition("#")
    scheme, mark, rest = address.partition("://")
    host, _, path = (rest if mark else scheme).partition("/")
    lang = next((p for p in path.partition("?")[0].split("/") if p), "")
    if not lang or not fragment:
        return url
    inner = unquote(fragment)
    if inner[0] != "{" or inner[-1] != "}":
        inner = "{" + inner.strip("{} \n\t") + "}"
    try:
        named = json.loads(inner)
    except (ValueError, RecursionError):
        return url
    items = next((named[k] for k in ITEM_KEYS if named.get(k)), None)
    if isinstance(items, list) and isinstance(items[0], str):
        return f"https://{host}/{lang}?i={items[0]}"
    return url


def normal_url(url: Column) -> Column:
    """normalise_url() of a column; null for null."""
    return F.pandas_udf(lambda s: s.map(normalise_url, na_action="ignore"), "string")(url)


def normal_urls(urls: Column) -> Column:
    """normalise_url() of each element of an array of strings; null for null."""
    return F.pandas_udf(lambda s: pd.Series([None if u is None else [x if x is None else normalise_url(x) for x in u] for u in s], dtype=object), "array<string>")(urls)
