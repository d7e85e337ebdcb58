"""Operators of a training-data pipeline (see README, "llm").

Nothing else in the library imports this subpackage.
"""
