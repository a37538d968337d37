"""Operators over DataFrames: graph, vectors, extraction, search, answers, dialogue and storage."""
