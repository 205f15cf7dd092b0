"""Tokenising by units that no token crosses, each distinct one encoded once per worker while memory allows."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa

#: Where a single blank stands between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than blanks and line feeds.
_OTHER = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Units longer than this are not remembered, and no more units than about this are: frequent ones come early.
LONGEST, MOST = 64, 200_000


_loaded: dict[tuple, object] = {}


def loaded(key: tuple, build: Callable[[], object]):
    """The one large model, with what it remembers, that a worker keeps; another one takes its place."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = build()
    return _loaded[key]


def forget() -> None:
    """Let go of the model: for tasks that need none, so that a worker doesn't hold the last stage's beside their work."""
    _loaded.clear()
    pa.default_memory_pool().release_unused()


def cut(text: str) -> list[str]:
    """``text`` cut at its single blanks; all but the first unit lack the blank before them."""
    if "  " in text or " \n" in text or "\n " in text or _OTHER.search(text):
        return CUT.split(text)
    return text.split(" ")


class UnitEncoder:
    """Ids of texts as little-endian bytes, put together from remembered units.

    ``encode`` gives the ids of a list of strings, each as bytes. ``head`` and ``tail`` stand before the first and before
    every other unit of a text.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], head: str = "", tail: str = " ", split: Callable[[str], list[str]] = cut):
        self.encode, self.marks, self.split = encode, (head, tail), split
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _units(self, which: int, units: list[str]) -> bytes:
        known = self.known[which]
        parts = list(map(known.get, units))
        if None not in parts:
            return b"".join(parts)
        new = list({u for u, p in zip(units, parts) if p is None})
        made = dict(zip(new, self.encode([self.marks[which] + u for u in new])))
        out = b"".join([made[u] if p is None else p for u, p in zip(units, parts)])
        if len(known) < MOST:
            known.update((u, ids) for u, ids in made.items() if len(u) <= LONGEST)
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            first, *rest = self.split(text)
            out.append(self._units(0, [first]) + self._units(1, rest))
        return out
