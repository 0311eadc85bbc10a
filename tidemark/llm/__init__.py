"""Operators for preparing training text: extraction, deduplication, language, tokens, secrets, packing."""
