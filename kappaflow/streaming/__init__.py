"""Structured Streaming: the row-local grading operators on a file stream."""
