"""newsloom: a Spark-native analytics engine for article streams."""
