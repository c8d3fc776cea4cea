"""A PySpark engine for analytics over recorded agent conversations."""
