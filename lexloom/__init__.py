"""lexloom: PySpark-native analytics for short-text corpora with few labels."""
