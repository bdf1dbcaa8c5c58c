"""Part of skerry, a Spark-native search and analytics engine."""
