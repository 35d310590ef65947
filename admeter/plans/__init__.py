from .campaigns import evaluate_run, prepare, run_campaigns
from .comparison import compare_runs, compare_versions
from .requests import analysis_requests, recommendation_requests, request_payloads

__all__ = [
    "evaluate_run", "prepare", "run_campaigns", "compare_runs", "compare_versions",
    "analysis_requests", "recommendation_requests", "request_payloads",
]
