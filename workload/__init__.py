"""Checked queries over the test tables (not part of the library)."""

from . import ads, contracts, diagnosis, files, replies
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
