"""entwyne: a Spark-native engine that links records describing the same thing."""
