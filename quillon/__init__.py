"""quillon: a Spark-native engine for recommender data and training-data corpora."""

__version__ = "0.1.0"
