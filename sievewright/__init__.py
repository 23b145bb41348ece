"""sievewright: Spark-native processing of listing and document pipelines."""
