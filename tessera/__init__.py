"""tessera: a Spark-native analytics engine (relational, run-length and set-similarity operators)."""

__version__ = "0.1.0"
