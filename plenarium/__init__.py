"""plenarium: a PySpark engine for mention-level parliamentary text corpora."""
