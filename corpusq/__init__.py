"""corpusq: a Spark-native query engine for annotated text corpora."""

__version__ = "0.1.0"
