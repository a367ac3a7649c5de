"""Operators of a training-data pipeline: media, archives, tokens, quality, dedup, search, licences, mixing."""
