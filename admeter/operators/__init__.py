"""Operators by concern; see the module docstrings."""
