"""A Spark-native engine that aligns commentary lines with the source lines they quote."""
