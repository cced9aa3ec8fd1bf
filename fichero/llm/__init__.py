"""Operators for preparing training data: language, deduplication, search, tokens, archives, mixing, toxicity, scoring."""
