"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
``opN_*`` queries over the shared tables and their SQL counterparts.
"""
