"""Training-data pipeline operators (deduplication, quality, tokenisation, mixing).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it can be imported.
"""
