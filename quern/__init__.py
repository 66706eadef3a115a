"""quern: a Spark-native analytics engine for social-post corpora."""

__version__ = "0.1.0"
