"""Byte-level encoding by a public rank file, whole texts at any length, with the byte borders of the tokens.

The library's pattern matcher gives up on very long runs of white space. Such a run is cut out exactly where the pattern
itself would part it (before its first character, and before its last one if a visible character follows) and merged as
one piece, so ids are the same as if the matcher had no limit.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Fixed value: the public pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the characters of the property White_Space, which is what the pattern's \s stands for.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class ByteBpe:
    """An encoder of texts. special are strings that become a token each, in the order of the ids after the ranks."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN, special: tuple[str, ...] = (), long_run: int = 1 << 14) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        first = max(ranks.values()) + 1
        self.special = {s: first + i for i, s in enumerate(special)}
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.lengths = np.zeros(first + len(special), np.int64)
        self.lengths[list(ranks.values())] = [len(token) for token in ranks]
        self.lengths[first:] = [len(s.encode()) for s in special]
        self._allowed = set(special)
        self._run = re.compile(f"[{SPACES}]{{{long_run},}}")
        self._marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; special strings in it are special tokens."""
        if self._run.search(text):
            parts = self._marks.split(text) if self._marks else [text]
            found = [[self.special[p]] if i % 2 else self._cut(p) for i, p in enumerate(parts)]
            return np.array([x for part in found for x in part], np.int64)
        if self.special:
            return np.array(self.model.encode(text, allowed_special=self._allowed, disallowed_special=()), np.int64)
        return np.array(self.model.encode_ordinary(text), np.int64)

    def _cut(self, text: str) -> list[int]:
        """Ids of a text without special strings, its long runs of white space apart."""
        out, at = [], 0
        for run in self._run.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self.model.encode_ordinary(text[at : run.start()])
            out += self.model._core_bpe.encode_single_piece(text[run.start() : end].encode())
            at = end
        return out + self.model.encode_ordinary(text[at:])

    def borders(self, ids: np.ndarray) -> np.ndarray:
        """Byte borders: token i covers borders[i] to borders[i + 1]."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])


def char_spans(text: str, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, from byte borders; a character in several tokens lies in each of them."""
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) == len(text):
        return borders[:-1], borders[1:]
    count = np.cumsum((data & 0xC0) != 0x80)
    return count[borders[:-1]] - 1, count[borders[1:] - 1]


@lru_cache(maxsize=4)
def shared(path: str = RANKS, pattern: str = PATTERN, special: tuple[str, ...] = ()) -> ByteBpe:
    """One encoder for each process and setting."""
    return ByteBpe(path, pattern, special)
