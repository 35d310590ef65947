from .files import load, read
from .runs import (
    analysis_evaluator_inputs, evaluation_records, read_result_text, recommendation_evaluator_inputs,
)

__all__ = [
    "load", "read", "analysis_evaluator_inputs", "evaluation_records", "read_result_text",
    "recommendation_evaluator_inputs",
]
