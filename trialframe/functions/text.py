"""String predicates and recodes (all JVM-side)."""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_prefix(col, prefixes) -> Column:
    """True when the value starts with any of the prefixes (OR over a list)."""
    c = _c(col)
    return reduce(or_, [c.startswith(p) for p in prefixes])


def matches_any(col, patterns, case_insensitive: bool = True) -> Column:
    """Regex alternation, case-insensitive by default."""
    c = F.lower(_c(col)) if case_insensitive else _c(col)
    pats = [p.lower() for p in patterns] if case_insensitive else list(patterns)
    return c.rlike("|".join(pats))


def normalise_ndc(col) -> Column:
    """Drug code normalisation: ``'0' || replace(code, '-', '')``."""
    return F.concat(F.lit("0"), F.regexp_replace(_c(col), "-", ""))


def label_from_map(col, mapping: dict, default=None) -> Column:
    """Value -> label by a literal map (bounded, compiled into the plan)."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    out = m[_c(col)]
    return out if default is None else F.coalesce(out, F.lit(default))
