"""A PySpark engine for ingesting, indexing and searching conversation transcripts."""

__version__ = "0.1.0"
