"""Governed record processing on Spark DataFrames: read, validate, redact, canonicalise, version and trace."""
