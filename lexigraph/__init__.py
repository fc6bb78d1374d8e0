"""lexigraph: a Spark-native engine for product knowledge graphs."""
