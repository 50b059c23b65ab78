"""Operators for building language-model training corpora.

Nothing outside this package imports it; its queries are registered by
``llm.queries`` and picked up by ``__spark_entry__`` when the package is there.
"""
