"""Training-data operators: fingerprints, near-dedup, mixing, encoding, sharding, scoring, decontamination.

Nothing outside this folder imports it; the repository works without it.
"""
