"""A Spark-native engine for archives of semi-structured documents whose fact rows are values as printed."""
