"""Training-data operators (dedup, quality, toxicity, mixing, sharding, packing).

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only if the package is there.
"""
