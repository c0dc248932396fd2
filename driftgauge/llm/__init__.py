"""Operators for large training-data pipelines. Nothing outside this subpackage imports it but ``__spark_entry__``."""
