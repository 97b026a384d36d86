"""Column functions: lenient casts, fallbacks, key normalisation, display formats."""

from innsight.functions.clean import (  # noqa: F401
    fill_unknown,
    lenient_timestamp,
    month_key,
    month_label,
    norm_key_lower,
    norm_key_upper,
    numeric0,
    to_number0,
    transaction_status,
    truncate_int,
    value_or,
    wall_clock,
    default_if_blank,
)
from innsight.functions.formats import pct, fixed, thousands, one_decimal_pct  # noqa: F401
