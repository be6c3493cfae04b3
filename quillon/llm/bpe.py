"""Exact byte-pair encoding by longest matches and adjacent-token compatibility.

A token sequence is the encoding of its bytes exactly if each two neighbours, taken alone, encode to themselves. So a
piece needs no merge queue: one pass of an Aho-Corasick automaton over its bytes (as Latin-1 characters) gives the
longest token at each position; tokens are laid from the left, a token that doesn't go with its left neighbour gives
way to its longest proper prefix that is a token, and a position from which nothing goes on is closed for good. Each
position is closed at most once, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import functools

import ahocorasick
import regex

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
# Fixed value: the split of the published tokenizer into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries a cache may hold before it starts anew; affects speed only.
CACHE = 400_000
#: Characters up to which a piece's ids are cached.
CACHED_CHARS = 40


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        self.split = regex.compile(PIECES).findall
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.shorter = {}
        for token, i in self.ranks.items():
            n = len(token) - 1
            while n and token[:n] not in self.ranks:
                n -= 1
            self.shorter[i] = self.ranks[token[:n]] if n else -1
        self._goes: dict[int, bool] = {}
        self._ids: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the neighbours of lowest rank until none can be merged."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def goes(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together; memoised."""
        key = left << 20 | right
        known = self._goes.get(key)
        if known is None:
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self._goes) >= 4 * CACHE:
                self._goes.clear()
            self._goes[key] = known
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(data.decode("latin-1")):
            if end - size + 1 >= 0:
                if longest[end - size + 1] < 0 or self.length[longest[end - size + 1]] < size:
                    longest[end - size + 1] = i
        length, shorter, goes = self.length, self.shorter, self.goes
        out: list[int] = []
        is_open = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            left = out[-1] if out else -1
            while token >= 0 and not (is_open[at + length[token]] and (left < 0 or goes(left, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at < n:
                    token = longest[at]
            else:
                is_open[at] = 0
                token = shorter[out.pop()]
                at -= length[left]
        return out

    def piece(self, piece: str) -> tuple[int, ...]:
        known = self._ids.get(piece)
        if known is None:
            known = tuple(self.encode_bytes(piece.encode("utf-8")))
            if len(piece) <= CACHED_CHARS:
                if len(self._ids) >= CACHE:
                    self._ids.clear()
                self._ids[piece] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text; none for an empty or null text. Strings of special tokens are ordinary text."""
        out: list[int] = []
        if text:
            known = self._ids
            for p in self.split(text):
                out += known.get(p) or self.piece(p)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known = self._ids
        return sum(len(known.get(p) or self.piece(p)) for p in self.split(text))


@functools.cache
def vocabulary(folder: str = TOKENIZERS, name: str = NAME) -> Vocabulary:
    """The vocabulary, built once for each Python worker."""
    return Vocabulary(f"{folder}/{name}.tiktoken")
