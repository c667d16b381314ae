"""Operators for preparing training data: packing, near and exact duplicates, quality
rules, toxicity, page text, tokens, secrets and repeated substrings.

Nothing else in the library imports this subpackage.
"""
