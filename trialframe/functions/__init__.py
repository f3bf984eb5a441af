"""Column-level helpers: time arithmetic, deterministic hashing, text matching.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so that
it stays inside whole-stage code generation; none of them is a Python UDF.
"""

from trialframe.functions.time import (  # noqa: F401
    epoch_micros, seconds_between, hours_between, floor_days_between,
    days_between, minutes_between, shift, ceil_to_hour, hour_grid,
)
from trialframe.functions.hashing import uniform, poisson1, hash_rank_key  # noqa: F401
from trialframe.functions.text import (  # noqa: F401
    any_prefix, matches_any, normalise_ndc, label_from_map,
)
