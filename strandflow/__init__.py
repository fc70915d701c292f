"""Spark-native analytics for repeat loci: keyed DataFrame operators, plans and sources."""
