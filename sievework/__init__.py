"""A PySpark-native engine for building, searching and evaluating labelled text corpora."""
