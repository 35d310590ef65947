from .scores import append_score_stream, score_stream

__all__ = ["append_score_stream", "score_stream"]
