"""Interfaces for models that run in tasks: embedders, generators and judges.

A handler is made once for each Python worker from a function without arguments, so a model is
loaded where it runs; texts come to it in lists of at most ``batch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Handler = Callable[[list[str]], list]


def _calls(make: Callable[[], Handler], kind: str, batch: int):
    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        handler = make()
        for part in parts:
            out: list = [None] * len(part)
            at = [i for i, t in enumerate(part) if t is not None]
            for lo in range(0, len(at), batch):
                some = at[lo : lo + batch]
                found = handler([part.iloc[i] for i in some])
                if len(found) != len(some):
                    raise ValueError(f"{len(some)} texts, {len(found)} results")
                for i, x in zip(some, found, strict=True):
                    out[i] = x
            yield pd.Series(out, dtype=object)

    return run


def embedded(text: Column, make: Callable[[], Handler], batch: int = 64) -> Column:
    """Vectors of texts; a null text has none."""
    return _calls(make, "array<float>", batch)(text)


def generated(prompt: Column, make: Callable[[], Handler], batch: int = 16) -> Column:
    """Answers to prompts; a null prompt has none."""
    return _calls(make, "string", batch)(prompt)


def judged(prompt: Column, make: Callable[[], Handler], batch: int = 16) -> Column:
    """Verdicts on prompts, false where no verdict can be read from the judge's answer."""
    from decilens.functions.text import verdict

    return F.coalesce(verdict(generated(prompt, make, batch)), F.lit(False))
