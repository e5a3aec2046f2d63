"""Operators for text corpora: quality, archives, safety, tokens, duplicates, language models.

Nothing outside this subpackage imports it. ``registry`` lists its queries.
"""
