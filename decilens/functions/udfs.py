"""What SQL has no function for, as Arrow UDFs: recursive chunks, Unicode folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from decilens.functions.text import check_chunking

SEPARATORS = ("\n\n", "\n", " ", "")


def _units(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs; a
    separator stays in front of the piece behind it."""
    if len(text) <= size:
        return [text] if text else []
    for i, sep in enumerate(separators):
        if not sep:
            return [text[j : j + size] for j in range(0, len(text), size)]
        if sep in text:
            head, *rest = text.split(sep)
            parts = ([head] if head else []) + [sep + r for r in rest]
            return [u for p in parts for u in _units(p, size, separators[i + 1 :])]
    return [text]


def recursive_split(text: str | None, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` characters from whole units; a chunk starts with the last
    units of the one before it, as many as ``overlap`` characters hold. An empty text is one
    empty chunk."""
    out: list[str] = []
    window: list[str] = []
    length = 0
    for unit in _units(text or "", size, SEPARATORS):
        if window and length + len(unit) > size:
            out.append("".join(window).strip())
            while window and (length > overlap or length + len(unit) > size):
                length -= len(window.pop(0))
        window.append(unit)
        length += len(unit)
    if window:
        out.append("".join(window).strip())
    return [c for c in out if c] or [""]


def recursive_chunks(size: int = 1000, overlap: int = 100):
    check_chunking(size, overlap)

    @F.pandas_udf("array<string>")
    def chunks(text: pd.Series) -> pd.Series:
        return text.map(lambda t: recursive_split(t, size, overlap))

    return chunks


def folding():
    """NFKC, single spaces, case folded."""

    @F.pandas_udf("string")
    def folded(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())

    return folded
