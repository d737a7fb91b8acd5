"""Reusable column-expression helpers (JVM-side, codegen friendly)."""

from convolake.functions.columns import (  # noqa: F401
    round_half_up, round_int, safe_div, word_count, pct,
)
from convolake.functions.patterns import first_match, any_contains  # noqa: F401
