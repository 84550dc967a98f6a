"""Structured Streaming forms of the batch operators.

Every stream uses the batch column expressions; the batch operator is its oracle.
"""
