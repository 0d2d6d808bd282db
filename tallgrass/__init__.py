"""tallgrass: a Spark-native engine for scoring, de-duplicating and auditing text corpora."""
