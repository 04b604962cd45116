"""Classes and lower case of all code points as the tokenizer library has them; Python's tables are of other versions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

#: Half-open ranges of code points that no text holds.
SURROGATES = (0xD800, 0xE000)


def written(ranges: list[tuple[int, int]]) -> str:
    """Half-open ranges as the inside of a character class."""
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in ranges)


@lru_cache(maxsize=1)
def tables() -> dict:
    """``letters`` and ``numbers`` as half-open ranges, ``lower`` for characters that Python lowers otherwise and
    ``differing``, ranges whose class Python's patterns have otherwise.

    The library itself cuts and lowers a text of all code points, so this belongs on the driver, once.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = np.concatenate([np.arange(SURROGATES[0]), np.arange(SURROGATES[1], 0x110000)])
    every = "".join(map(chr, points.tolist()))

    def ranges(mask: np.ndarray) -> list[tuple[int, int]]:
        own = points[mask]
        if not len(own):
            return []
        cut = np.flatnonzero(np.diff(own) != 1) + 1
        return [(int(p[0]), int(p[-1]) + 1) for p in np.split(own, cut)]

    def held(name: str) -> np.ndarray:
        found = pre_tokenizers.Split(Regex(rf"\p{{{name}}}+"), "removed", invert=True).pre_tokenize_str(every)
        mask = np.zeros(len(points), dtype=bool)
        for _, (a, b) in found:
            mask[a:b] = True
        return mask

    def ours(name: str) -> np.ndarray:
        mask = np.zeros(len(points), dtype=bool)
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            mask[m.start() : m.end()] = True
        return mask

    letters, numbers = held("L"), held("N")
    others = [c for c in every if c not in "\n"]
    low = normalizers.Lowercase().normalize_str("\n".join(others)).split("\n")
    return {
        "letters": ranges(letters),
        "numbers": ranges(numbers),
        "differing": ranges((letters != ours("L")) | (numbers != ours("N"))),
        "lower": {c: x for c, x in zip(others, low) if c.lower() != x},
    }
