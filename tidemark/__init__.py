"""tidemark: a PySpark-native engine for set-oriented text correction and retrieval analytics."""
