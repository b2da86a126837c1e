"""Training-data operators: extraction, filtering, deduplication, packing.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
when it is present.
"""
