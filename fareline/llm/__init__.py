"""Operators of a training-data pipeline: tokens, copies, quality, language, archives, search."""
