"""Relational operators: encoding, grading, agreement, statistics, profiles."""
