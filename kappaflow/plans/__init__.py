"""User-level compositions: grading methods, model calls, stage tables, query registry."""
