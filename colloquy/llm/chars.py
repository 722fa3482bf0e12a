"""Texts as arrays of small letter codes, for scoring many texts at once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Code points handled at once.
BATCH_CHARS = 500_000


@lru_cache(maxsize=4)
def letter_table(folded: bool, codes: int) -> np.ndarray:
    """Code of every code point of the basic plane: 0 for what isn't a letter, 1 to 26 for a to z, the rest by remainder.

    ``folded``: a letter with marks counts as its base letter.
    """
    out = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        out[cp] = letter_code(chr(cp), folded, codes)
    return out


def letter_code(char: str, folded: bool, codes: int) -> int:
    if not char.isalpha():
        return 0
    base = char.lower()[0]
    if folded:
        base = unicodedata.normalize("NFKD", base)[0]
    return ord(base) - 96 if "a" <= base <= "z" else 27 + ord(base) % (codes - 27)


def coded(texts: list[str], pad: int, folded: bool, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of ``texts`` with ``pad`` zeros before each and after the last; where each text starts and ends."""
    gap = "\0" * pad
    points = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + pad)
    out = letter_table(folded, codes)[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        kinds, which = np.unique(points[far], return_inverse=True)
        out[far] = np.array([letter_code(chr(p), folded, codes) for p in kinds], np.uint8)[which]
    return out, ends - lengths, ends


def batches(texts: list[str | None]):
    """(first, texts) of slices of about BATCH_CHARS code points; null texts are empty."""
    lo, chars, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(t or "")
        chars += len(part[-1])
        if chars >= BATCH_CHARS or i + 1 == len(texts):
            yield lo, part
            lo, chars, part = i + 1, 0, []
