"""Spark-native breakpoint analytics: DataFrame-to-DataFrame operators and the pipeline built of them."""
