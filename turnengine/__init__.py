"""PySpark-native engine for building and judging parallel conversation corpora."""
