"""kinspan: a Spark-native record-linkage and corpus-preparation engine."""
