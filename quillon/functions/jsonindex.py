"""Structural indexing of JSON texts in blocks: bitmaps of quotes, brackets and delimiters, nesting depth by prefix sums.

A block of texts is one byte array. Escapes, strings, brackets and scalars are found by whole-array operations; the
depth of each token is the running sum of opening and closing brackets, the parent of a token the last bracket opened
one level up. The grammar is checked on neighbouring tokens, so that texts that no JSON reader takes are left out.
"""

from __future__ import annotations

import json
import re

import numpy as np

OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COMMA, COLON, STRING, SCALAR = range(1, 9)
_KINDS = np.zeros(256, dtype=np.uint8)
for _c, _k in zip(b"{}[],:", (OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COMMA, COLON)):
    _KINDS[_c] = _k
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 13, 32]] = True
_ESCAPES = np.zeros(256, dtype=bool)
_ESCAPES[[*b'"\\/bfnrtu']] = True
_SCALARS = re.compile(rb"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|NaN|-?Infinity")
_HEX = re.compile(rb"[0-9a-fA-F]{4}")


class Index:
    """Tokens of a block of texts.

    Arrays over tokens: kind, doc, parent (token of the bracket that holds it, -1 at the root), start and end (bytes of
    the text, strings without quotes), key (token of its key in an object, else -1), pos (place in its array or object),
    value (whether it begins a value). valid: over texts.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = data = b"\n".join(texts) + b"\n"
        b = np.frombuffer(data, dtype=np.uint8)
        size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        first = np.cumsum(size) - size
        n_docs = len(texts)
        self.valid = valid = np.ones(n_docs, dtype=bool)

        slash = np.flatnonzero(b == 92)
        escaped = np.zeros(len(b) + 1, dtype=bool)
        if len(slash):
            new = np.r_[True, np.diff(slash) > 1]
            run = slash[new][np.cumsum(new) - 1]
            escaping = slash[(slash - run) % 2 == 0]
            escaped[escaping + 1] = True
        escaped = escaped[:-1]
        quote = (b == 34) & ~escaped
        quotes = np.cumsum(quote, dtype=np.int32)
        before = np.r_[0, quotes][first].astype(np.int32)
        inside = ((quotes - np.repeat(before, size)) & 1).astype(bool)  # from the opening quote up to before the closing one
        doc_of = lambda at: np.searchsorted(first, at, side="right") - 1
        valid[doc_of(np.flatnonzero(inside & (b < 32)))] = False  # also strings that don't end
        if len(slash):
            bad = escaping[inside[escaping] & ~_ESCAPES[b[np.minimum(escaping + 1, len(b) - 1)]] | ~inside[escaping]]
            valid[doc_of(bad)] = False
            for at in escaping[b[np.minimum(escaping + 1, len(b) - 1)] == 117].tolist():
                if not _HEX.match(data, at + 2):
                    valid[doc_of(at)] = False

        kinds = np.where(inside | quote, 0, _KINDS[b])
        plain = ~inside & ~quote & (kinds == 0) & ~_SPACE[b]
        scalar = plain & ~np.r_[False, plain[:-1]]
        opening = quote & inside
        kinds[opening] = STRING
        kinds[scalar] = SCALAR
        at = np.flatnonzero(kinds)
        kind = kinds[at]
        doc = np.repeat(np.arange(n_docs), np.diff(np.searchsorted(at, np.r_[first, len(b)])))
        n = len(at)
        end = at + 1
        closing = np.flatnonzero(quote & ~inside)
        is_string = kind == STRING
        place = np.searchsorted(closing, at[is_string])
        end[is_string] = np.r_[closing, len(b)][place]
        stops = np.flatnonzero(~plain & np.r_[False, plain[:-1]])
        is_scalar = kind == SCALAR
        end[is_scalar] = stops[np.searchsorted(stops, at[is_scalar])]

        opens = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY)
        closes = (kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY)
        depth = np.cumsum(opens.astype(np.int32) - closes, dtype=np.int32)
        start_token = np.searchsorted(at, first)
        depth -= np.repeat(np.r_[0, depth][start_token], np.diff(np.r_[start_token, n])).astype(np.int32)
        level = depth - opens  # of the bracket that holds the token; a closing bracket has that of its opening one
        valid[doc[level < 0]] = False
        last_token = np.r_[start_token[1:], n] - 1
        some = last_token >= start_token
        valid[~some] = False
        valid[some] &= depth[last_token[some]] == 0

        parent = np.full(n, -1, dtype=np.int64)
        match = np.full(n, -1, dtype=np.int64)
        order = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[order], np.arange(0, (int(level.max()) if n else -1) + 3))
        for lev in range(len(bounds) - 2):
            here = order[bounds[lev] : bounds[lev + 1]]
            open_here = here[opens[here]]
            if not len(open_here):
                break
            close_here = here[closes[here]]
            match[close_here] = open_here[np.maximum(np.searchsorted(open_here, close_here) - 1, 0)]
            below = order[bounds[lev + 1] : bounds[lev + 2]]
            below = below[~closes[below]]
            parent[below] = open_here[np.maximum(np.searchsorted(open_here, below) - 1, 0)]

        prev = np.r_[0, kind[:-1]].astype(np.uint8)
        prev[start_token[start_token < n]] = 0
        in_object = (parent >= 0) & (kind[parent] == OPEN_OBJECT)
        is_key = is_string & in_object & ((prev == OPEN_OBJECT) | (prev == COMMA))
        after_key = np.r_[False, is_key[:-1]]
        value = (opens | is_string | is_scalar) & ~is_key
        value_end = np.isin(prev, (CLOSE_OBJECT, CLOSE_ARRAY, STRING, SCALAR)) & ~after_key
        good = is_key.copy()
        good |= value & ((prev == COLON) | (prev == OPEN_ARRAY) | (prev == 0) | (prev == COMMA) & ~in_object) & ((level > 0) | (prev == 0))
        good |= (kind == COLON) & after_key & (prev == STRING)
        good |= (kind == COMMA) & value_end & (level > 0)
        good |= closes & (value_end | (prev == np.where(kind == CLOSE_OBJECT, OPEN_OBJECT, OPEN_ARRAY))) & (match >= 0) & (kind[match] == kind - 1)
        valid[doc[~good]] = False
        for i in np.flatnonzero(is_scalar).tolist():
            if not _SCALARS.fullmatch(data, at[i], end[i]):
                valid[doc[i]] = False

        self.kind, self.doc, self.parent, self.value = kind, doc, parent, value & valid[doc]
        self.start = at + is_string
        self.end = end
        self.key = np.where(value & in_object, np.arange(n) - 2, -1)
        rank = np.zeros(n, dtype=np.int64)
        values = np.flatnonzero(value)
        by_parent = values[np.argsort(parent[values], kind="stable")]
        p = parent[by_parent]
        fresh = np.r_[True, p[1:] != p[:-1]] if len(p) else np.zeros(0, dtype=bool)
        rank[by_parent] = np.arange(len(p)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(p) else 0
        self.pos = rank
        self._bytes = b

    def text(self, token: int) -> str:
        """The content of a string, or a scalar as it is written."""
        raw = self.data[self.start[token] : self.end[token]]
        if self.kind[token] == STRING and b"\\" in raw:
            return json.loads(b'"' + raw + b'"')
        return raw.decode("utf-8", "replace")

    def named(self, tokens: np.ndarray, name: str) -> np.ndarray:
        """Those of the tokens whose key is the name; of several in one object the last."""
        target = np.frombuffer(name.encode(), dtype=np.uint8)
        key = self.key[tokens]
        there = key >= 0
        there &= (self.end[key] - self.start[key] == len(target)) & there
        found = tokens[there]
        if len(found):
            at = self.start[self.key[found]]
            found = found[(self._bytes[at[:, None] + np.arange(len(target))] == target).all(axis=1)]
        if len(found):
            p = self.parent[found]
            order = np.argsort(p, kind="stable")
            last = np.r_[p[order][1:] != p[order][:-1], True]
            found = np.sort(found[order[last]])
        return found

    def inside(self, holders: np.ndarray) -> np.ndarray:
        """Values held directly by any of the brackets."""
        mark = np.zeros(len(self.kind), dtype=bool)
        mark[holders] = True
        return np.flatnonzero(self.value & (self.parent >= 0) & mark[self.parent])

    def roots(self) -> np.ndarray:
        return np.flatnonzero(self.value & (self.parent < 0))
