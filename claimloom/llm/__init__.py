"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; its queries are listed in
``queries.py`` and joined to the others by ``__spark_entry__.py``.
"""
