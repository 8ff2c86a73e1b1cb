"""Quern: vector search, sequence matching, signal features, codecs, event policy and catalog upkeep on Spark."""
