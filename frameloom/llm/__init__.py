"""Training-data operators: fingerprints, classifiers, token files, deduplication, mixing, archives and packing.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
