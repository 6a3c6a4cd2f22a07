"""Words of text as NumPy arrays over whole batches."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: Soft hyphen, zero-width space and zero-width no-break space are nothing.
NOTHING = ("\u00ad", "\u200b", "\ufeff")


@cache
def alphanumeric() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@cache
def blank() -> np.ndarray:
    """Whether each code point is white space."""
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def plain(text: str) -> str:
    """A text without what doesn't count: case, compatibility forms, soft hyphens and zero-width spaces."""
    if text.isascii():
        return text.lower()
    for c in NOTHING:
        text = text.replace(c, "")
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def spaced_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, place where each text begins, and one past the last): the words of each text, one blank before
    each word and one after the last. Words are runs of letters and digits of `plain` text; a null text has none."""
    marked = "\x00" + "\x00".join(plain(t).replace("\x00", " ") if t else "" for t in texts) + "\x00"
    cp = code_points(marked)
    word = alphanumeric()[cp]
    keep = word.copy()
    keep[:-1] |= word[1:]
    edge = cp == 0
    keep |= edge
    out = np.where(word, cp, 32)[keep]
    return out.astype(np.uint32), np.flatnonzero(edge[keep])
