"""spanloom: exact, Spark-native text analytics."""
