"""Operators for text corpora: privacy, deduplication, quality, decontamination, language models and mixing."""
