"""Distinct words of texts, each encoded once a worker, for tokenizers none of whose tokens cross a word's edge.

A word here is a run of blanks and line feeds with what follows up to the next such run. The edge lies between a character
that no tokenizer takes for white space and a blank or line feed: a byte-level pattern always ends a match there, and a
piece model whose pieces have the marker in front only has no merge across it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

#: White space, and what some tables of Unicode take for it, other than blank and line feed: behind these no word ends.
ODD = r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]"
WORDS = regex.compile(rf"[ \n]*[^ \n]+(?:(?<={ODD})[ \n]+[^ \n]*)*|[ \n]+")
#: The same where no such character stands before a blank or line feed.
PLAIN, NOT_PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+"), re.compile(rf"{ODD}[ \n]")
STEP = 8192


class WordTable:
    """word -> number, and its ids by each encoder. Emptied past a bound of words or characters, which only costs encoding anew.
    check: what is asked once of each word and its ids by each encoder; sure says of each text of the last call whether all its words passed."""

    def __init__(self, encoders: list[Callable[[list[str]], list[list[int]]]], bound: int = 300_000, chars: int = 1 << 25, check: Callable[..., bool] | None = None):
        self.encoders, self.bound, self.most, self.check = encoders, bound, chars, check
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.ids = [[np.zeros(0, np.int32)] for _ in self.encoders]
        self.length = [[np.zeros(0, np.int64)] for _ in self.encoders]
        self.start = [np.zeros(0, np.int64) for _ in self.encoders]
        self.passed = [np.zeros(0, bool)]

    def _add(self, words: list[str]) -> None:
        found = [encode(words) for encode in self.encoders]
        for k, got in enumerate(found):
            self.ids[k].append(np.fromiter(chain.from_iterable(got), np.int32))
            self.length[k].append(np.fromiter(map(len, got), np.int64, len(got)))
        if self.check:
            self.passed.append(np.fromiter(map(self.check, words, *found), bool, len(words)))
        n = len(self.number)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        self.chars += sum(map(len, words))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each encoder the ids of all texts in a row, and how many each text has."""
        words = [(WORDS if NOT_PLAIN.search(t) else PLAIN).findall(t) for t in texts]
        if len(self.number) > self.bound or self.chars > self.most:
            self.clear()
        if new := set().union(*words).difference(self.number):
            new = sorted(new)
            for i in range(0, len(new), STEP):
                self._add(new[i : i + STEP])
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64)
        edge = np.cumsum([0, *map(len, words)])
        if self.check:
            self.passed = [np.concatenate(self.passed)]
            failed = np.concatenate([[0], np.cumsum(~self.passed[0][at])])
            self.sure = failed[edge[1:]] == failed[edge[:-1]]
        out = []
        for k in range(len(self.encoders)):
            if len(self.ids[k]) > 1:
                self.ids[k], self.length[k] = [np.concatenate(self.ids[k])], [np.concatenate(self.length[k])]
                self.start[k] = np.cumsum(self.length[k][0]) - self.length[k][0]
            n = self.length[k][0][at]
            total = np.concatenate([[0], np.cumsum(n)])
            ids = self.ids[k][0][np.repeat(self.start[k][at] - total[:-1], n) + np.arange(total[-1])]
            out.append((ids, total[edge[1:]] - total[edge[:-1]]))
        return out


def byte_level(path: str, special: bool):
    """The tokenizers library's reader of a byte-level file, and the bytes of each id. special: whether added tokens' strings
    within texts are those tokens. One thread: Spark runs a task on each core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if t.normalizer is not None or type(t.pre_tokenizer).__name__ != "ByteLevel" or t.pre_tokenizer.add_prefix_space or t.truncation or t.padding:
        raise ValueError("not a plain byte-level file")
    t.encode_special_tokens = not special
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {i: a.content for i, a in t.get_added_tokens_decoder().items()}
    names = ((i, t.id_to_token(i)) for i in range(t.get_vocab_size()))
    return t, [added[i].encode() if i in added else bytes(byte[c] for c in s) for i, s in names], [*added.values()]
