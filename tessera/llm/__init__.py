"""Operators for large text, page, media and vector corpora."""
