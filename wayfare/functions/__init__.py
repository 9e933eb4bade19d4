"""Column-level building blocks (all built-in Spark expressions)."""

from .calendar import (DAY_NAMES, day_name, day_number_of_name, hms_to_hours, iso_week, month_end, month_name, month_number_of_name,
                       month_start, week_ending_monday)
from .keys import key_to_text
from .numeric import (nan_to_null, null_safe_sum, round_half_away, round_half_even_binary,
                      safe_div, to_double, to_long, zero_to_one)

__all__ = [
    "DAY_NAMES", "day_name", "day_number_of_name", "hms_to_hours",
    "iso_week", "month_end", "month_name", "month_number_of_name", "month_start",
    "week_ending_monday", "key_to_text", "nan_to_null", "null_safe_sum", "round_half_away",
    "round_half_even_binary", "safe_div", "to_double", "to_long", "zero_to_one",
]
