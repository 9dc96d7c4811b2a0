"""Operators for preparing training data: sharding, search, language, privacy, licenses, duplicates, packing."""
