"""loomtext: a PySpark-native engine for preparing and evaluating text corpora."""
