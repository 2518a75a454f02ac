"""tessera: Spark-native screening analytics (see README.md)."""
