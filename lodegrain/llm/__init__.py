"""Operators for preparing training text: filtering, matching, encoding, grouping and archiving."""
