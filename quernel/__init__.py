"""quernel: a Spark-native engine for a typed query DSL, data sets, comparison and schema evolution."""
