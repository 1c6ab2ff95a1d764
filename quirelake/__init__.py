"""quirelake: Spark-native analytics over bibliographic and document collections."""
