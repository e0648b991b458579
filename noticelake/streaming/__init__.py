"""Incremental forms of the batch operators (R1-R4, R8, R9), on Structured Streaming."""
