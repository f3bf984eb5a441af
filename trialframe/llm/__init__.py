"""Operators of a large-scale training-data pipeline over text, pages and vectors.

One module per operator; ``entries`` registers their queries.  Nothing outside
this package imports it, except the guarded lookup in ``__spark_entry__``.
"""
