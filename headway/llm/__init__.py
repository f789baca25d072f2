"""Operators that prepare training text: sanitising, deduplication, extraction, selection and mixing."""
