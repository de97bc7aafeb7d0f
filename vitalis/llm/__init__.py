"""Training-data operators: deduplication, fingerprints, toxicity, tokens, packing.

Every operator is ``DataFrame -> DataFrame``; numpy and Arrow run inside tasks
that Spark partitions and shuffles. Nothing outside this subpackage imports it.
"""
