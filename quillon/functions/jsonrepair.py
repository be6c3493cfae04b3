"""JSON out of model replies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"(?s)```json\s*(.*?)\s*```")
#: What may follow a quote that closes a string.
AFTER_STRING = set(",:}]\n\r\t ")


def repair_quotes(text: str) -> str:
    """Quotes inside strings escaped: a quote closes its string only if a delimiter, white space or the end follows."""
    out: list[str] = []
    inside = False
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and inside:
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            if not inside:
                inside = True
            elif i + 1 >= len(text) or text[i + 1] in AFTER_STRING:
                inside = False
            else:
                out.append("\\")
        out.append(c)
        i += 1
    return "".join(out)


def json_of_reply(reply: str | None) -> tuple[str | None, str | None]:
    """(JSON text, error) of a reply: its fenced block, else all of it, with quotes repaired where needed."""
    if reply is None:
        return None, "No ```json block found"
    found = FENCE.search(reply)
    body = found[1] if found else reply.strip()
    for text in (body, repair_quotes(body)):
        try:
            json.loads(text)
        except ValueError:
            continue
        return text, None
    return None, "Invalid JSON format" if found or body[:1] in "{[" and body else "No ```json block found"


def extracted_json(reply: Column) -> Column:
    """struct<json string, error string> of each reply."""

    def run(replies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([json_of_reply(None if r is None or r != r else r) for r in replies], columns=["json", "error"])

    return F.pandas_udf(run, "json string, error string")(reply)
