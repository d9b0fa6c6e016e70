"""Operators for training data: packing, quality, extraction, decontamination, privacy, chat, duplicates, archives, language, shards."""
