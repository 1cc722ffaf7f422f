"""Training-data operators: dedup, PII, nearest neighbours, packing, sharding, tokens, toxicity, archives.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its queries when
it is present.
"""
