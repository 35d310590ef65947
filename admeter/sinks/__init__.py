from .commits import Attempt, committed, read_committed
from .writers import (
    append_prompts, append_scores, archive_prompts, high_water, stamp_run, write_dated_json, write_results, write_run_table,
)

__all__ = [
    "Attempt", "append_prompts", "append_scores", "archive_prompts", "committed", "high_water", "read_committed", "stamp_run",
    "write_dated_json", "write_results", "write_run_table",
]
