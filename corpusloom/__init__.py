"""corpusloom: a Spark-native corpus indexing and hybrid retrieval engine."""
