"""A PySpark engine that audits web pages and source text."""
