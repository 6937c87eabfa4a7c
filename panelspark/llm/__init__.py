"""Operators for preparing training corpora.

Nothing else in the package imports this subpackage; its queries are added to the catalog by
``__spark_entry__`` only when it can be imported.
"""
