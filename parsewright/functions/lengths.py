"""Length bands and sentence gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    """Foreign lengths that a phrase of n words may have: from int(a n + b), one at least, to int(c n + d)."""

    a: float
    b: float
    c: float
    d: float

    def columns(self, n: Column) -> tuple[Column, Column]:
        low = F.greatest((F.lit(self.a) * n + F.lit(self.b)).cast("int"), F.lit(1))
        return low, (F.lit(self.c) * n + F.lit(self.d)).cast("int")

    def of(self, n: int) -> tuple[int, int]:
        return max(1, int(self.a * n + self.b)), int(self.c * n + self.d)

    def sql(self, n: str) -> tuple[str, str]:
        """DuckDB expressions."""
        return f"greatest(CAST(trunc({self.a}::DOUBLE * {n} + {self.b}::DOUBLE) AS INT), 1)", f"CAST(trunc({self.c}::DOUBLE * {n} + {self.d}::DOUBLE) AS INT)"


#: The two length bands.
DEFAULT_BAND = Band(0.8, -1.999, 1.4, 2.001)
CHINESE_BAND = Band(1.1, -3.999, 1.7, 7.001)


@dataclass(frozen=True)
class Limits:
    """What a sentence pair may have at most; a pair beyond is rejected."""

    nodes: int = 40
    f_words: int = 29
    e_words: int = 19


def sentence_ok(nodes: Column, e_words: Column, f_words: Column, top: Column, lambda1: bool = True, lambda2: bool = True, limits: Limits = Limits()) -> Column:
    """Whether a pair fits: sizes, the root's upper band ``top``, and what insertions alone can reach without phrases."""
    ok = (f_words > 0) & (nodes <= limits.nodes) & (f_words <= limits.f_words) & (e_words <= limits.e_words) & (f_words <= top)
    reach = e_words + nodes >= f_words
    if not lambda2:
        ok = ok & (reach if not lambda1 else (reach | (e_words > 1)))
    return ok
