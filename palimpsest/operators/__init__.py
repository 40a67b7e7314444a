"""Operators over DataFrames: retrieval, versions, vectors, event log, graph, scheduling, matching, commands."""
