"""A Spark-native search and document analytics engine."""
