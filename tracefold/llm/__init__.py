"""Operators that prepare agent-run logs and texts as training data."""
