"""Operators for preparing language-model training data.

Each module holds one operator; ``queries`` registers the ``opN_*`` queries.
Nothing outside this package imports it (``__spark_entry__`` adds its queries
only when the package is there).
"""
