"""loomwright: a Spark-first analytics engine for linked-document corpora."""

__version__ = "0.1.0"
