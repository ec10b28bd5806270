"""All tunable numbers in one place; the defaults are those of the production run."""

from __future__ import annotations

import re
from dataclasses import dataclass

FUSIONS = ("linear", "rrf", "dense", "bm25")


@dataclass(frozen=True)
class Params:
    k1: float = 2.5
    b: float = 0.9
    min_df: int = 2
    max_df_ratio: float = 0.7
    pool: int = 2000
    doc_pool: int = 3000
    alpha: float = 0.7
    fusion: str = "linear"
    agg: str = "max+0.4"
    n_docs: int = 50
    m_chunks: int = 2
    beta: float = 0.5
    lam: float = 0.2
    topk: int = 5

    def __post_init__(self) -> None:
        if self.fusion not in FUSIONS:
            raise ValueError(f"unknown fusion {self.fusion!r}")
        parse_agg(self.agg)
        for name in ("alpha", "beta"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        for name in ("min_df", "pool", "doc_pool", "n_docs", "m_chunks", "topk"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")


def parse_agg(agg: str) -> tuple[str, float]:
    """('max', 0), ('top', n), ('top3_log', 3), ('max+', w) or ('avg', 0); anything else raises."""
    s = agg.replace(" ", "")
    if s in ("max", "avg"):
        return s, 0
    if s == "top3_log":
        return s, 3
    if m := re.fullmatch(r"top([1-9]\d*)", s):
        return "top", int(m.group(1))
    if m := re.fullmatch(r"max\+(\d+(?:\.\d+)?)", s):
        return "max+", float(m.group(1))
    raise ValueError(f"unknown aggregate {agg!r}")
