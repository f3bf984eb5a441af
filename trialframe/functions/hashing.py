"""Deterministic pseudo-random numbers keyed by row identity.

``rand()`` depends on partitioning and is not reproducible across executor
loss or re-planning; every random choice in the library (sampling, splits,
folds, bootstrap weights) is instead a function of ``md5(id|seed|...)`` so a
recomputed task yields the same rows, and DuckDB can reproduce it exactly:
``('0x' || substr(md5(concat_ws('|', id, seed)), 1, 15))::BIGINT / 2^60``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_60 = float(1 << 60)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_rank_key(*parts) -> Column:
    """First 32 bits of md5 of the parts joined by ``|`` as BIGINT."""
    cols = [_c(p) if not isinstance(p, (int, float)) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8),
                  16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """U[0,1) from 60 bits of the hash of the parts (deterministic sampling, splits, weights)."""
    cols = [_c(p) if not isinstance(p, (int, float)) else F.lit(p) for p in parts]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 15), 16, 10).cast("bigint")
    return h / F.lit(TWO_POW_60)


def poisson_thresholds(lam: float = 1.0) -> list[float]:
    """Cumulative Poisson probabilities P(K <= k), up to the last k that 60 bits can tell from the tail."""
    out, acc, term = [], 0.0, math.exp(-lam)
    while term * TWO_POW_60 >= 1:
        acc += term
        out.append(acc)
        term *= lam / len(out)
    return out


def poisson1(u: Column) -> Column:
    """Poisson(1) draw by inverse CDF of a uniform column (bootstrap weight)."""
    cdf = poisson_thresholds()
    expr = F.lit(len(cdf))
    for k, p in reversed(list(enumerate(cdf))):
        expr = F.when(u < F.lit(p), F.lit(k)).otherwise(expr)
    return expr


def poisson1_sql(u_sql: str) -> str:
    """The same draw as a SQL CASE expression (for DuckDB oracles)."""
    cdf = poisson_thresholds()
    arms = " ".join(f"WHEN {u_sql} < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(cdf))
    return f"(CASE {arms} ELSE {len(cdf)} END)"


def uniform_sql(*parts_sql: str) -> str:
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts_sql)
    return f"(('0x' || substr(md5(concat_ws('|', {joined})), 1, 15))::BIGINT / 1152921504606846976::DOUBLE)"
