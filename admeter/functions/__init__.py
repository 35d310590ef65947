from .scalar import (
    NUMERIC_TEXT, half_even, json_int, micros, micros_total, number, only_if, parse_timestamp, rounded,
    safe_ratio, text_or_unknown, truncated_long,
)
from .text import bound_figures, count_words, join_regex_words, numbers_in, times_of, unit_of, value_of

__all__ = [
    "NUMERIC_TEXT", "half_even", "json_int", "micros", "micros_total", "number", "only_if", "parse_timestamp",
    "rounded", "safe_ratio", "text_or_unknown", "truncated_long",
    "bound_figures", "count_words", "join_regex_words", "numbers_in", "times_of", "unit_of", "value_of",
]
