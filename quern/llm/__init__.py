"""Corpus operators for training data: packing, sharding, fingerprints, dedup, scoring and scans."""
