"""Operators for preparing training text: quality, tokenising, decontamination, search,
deduplication, sharding, extraction and toxicity.  Nothing else in the package imports it."""
