"""Operators for preparing training data: dedup, language, quality, privacy, extraction, archives, packing."""
