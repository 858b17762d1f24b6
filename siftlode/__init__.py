"""siftlode: a Spark-first engine for indexing, searching and analysing code and text corpora."""

__version__ = "0.1.0"
