"""Ids of whole texts by a byte-level BPE tokenizer, each distinct word being encoded once in a task.

A byte-level BPE encodes the words of its split pattern one by one, so a text's ids are those of its words.
The split is done on code points of many texts at once; a sorted table keeps the ids of the words met so far.
Texts with an apostrophe (contractions), an unassigned code point or a special token go to the tokenizer whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd

from .words import mix, powers

_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = 1, 2, 3, 4, 5
#: Words whose ids are kept in a task before the table starts anew.
MOST_WORDS = 1_500_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    points = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+"), (_UNKNOWN, r"\p{Cn}+")):
        for m in regex.finditer(pattern, points):
            a, b = ord(points[m.start()]), ord(points[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = _UNKNOWN
    out[ord("'")] = _UNKNOWN
    return out


class Encoder:
    """Encodes lists of texts; made once in each task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the bounds of each text's."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        kind = _classes()[points]
        hard = np.zeros(len(texts), bool)
        hard[np.searchsorted(bounds, np.flatnonzero(kind == _UNKNOWN), "right") - 1] = True
        for mark in self.special:
            if mark in joined:
                hard |= np.array([mark in t for t in texts])
        start, end = self._split(points, kind, bounds)
        ids, size = self._ids(joined, points, start, end)
        per_text = np.add.reduceat(np.append(size, 0), np.searchsorted(start, bounds[:-1])) * (np.diff(bounds) > 0)
        if not hard.any():
            return ids, np.concatenate([[0], np.cumsum(per_text)])
        cut = np.concatenate([[0], np.cumsum(per_text)])
        parts = [ids[cut[i] : cut[i + 1]] for i in range(len(texts))]
        at = np.flatnonzero(hard)
        for i, e in zip(at, self.tokenizer.encode_batch([texts[i] for i in at], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    @staticmethod
    def _split(points: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last code points of the split pattern's words."""
        n = len(points)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        run = np.concatenate([[True], kind[1:] != kind[:-1]]) | edge[:-1]
        space = kind == _SPACE
        after_blank = np.concatenate([[False], points[:-1] == 0x20]) & ~edge[:-1]
        start = run & ~(~space & after_blank)
        last_of_run = np.append(run[1:], True)
        start |= space & last_of_run & ~edge[1:]  # the last white space before a word stands alone or joins it
        at = np.flatnonzero(start)
        return at, np.append(at[1:], n)

    def _ids(self, joined: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(start):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        up, down = powers(len(points))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[: len(points)], dtype=np.uint64)])
        code, names = pd.factorize(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        place = np.minimum(np.searchsorted(self.keys, names), max(len(self.keys) - 1, 0))
        new = self.keys[place] != names if len(self.keys) else np.ones(len(names), bool)
        if new.any():
            if len(self.keys) > MOST_WORDS:
                self._clear()
                new = np.ones(len(names), bool)
            first = np.empty(len(names), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            at = first[new]
            self._learn(names[new], [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            place = np.searchsorted(self.keys, names)
        size, at = self.size[place][code], self.at[place][code]
        take = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.pool[take], size

    def _learn(self, names: np.ndarray, words: list[str]) -> None:
        # words that begin with a blank and go on with a letter can stand in one text without changing its split
        plain = np.array([len(w) > 1 and w[0] == " " and w[1].isalpha() for w in words])
        ids, size = [np.empty(0, np.int32)], np.zeros(len(words), np.int64)
        where = np.flatnonzero(plain)
        if len(where):
            e = self.tokenizer.encode("".join(words[i] for i in where), add_special_tokens=False)
            of = np.array(e.word_ids, np.int64)
            size[where] = np.bincount(of, minlength=len(where))
            ids.append(np.array(e.ids, np.int32))
        rest = np.flatnonzero(~plain)
        for i, e in zip(rest, self.tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            size[i] = len(e.ids)
            ids.append(np.array(e.ids, np.int32))
        order = np.concatenate([where, rest])
        at = np.empty(len(words), np.int64)
        at[order] = len(self.pool) + np.cumsum(size[order]) - size[order]
        self.pool = np.concatenate([self.pool, *ids])
        keys = np.concatenate([self.keys, names])
        sort = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[sort], np.concatenate([self.at, at])[sort], np.concatenate([self.size, size])[sort]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
