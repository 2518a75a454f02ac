"""Operators for training-data corpora (secrets, language, licences, neighbours,
near duplicates, shards, language-model scores, byte-pair encoding, mixing)."""
