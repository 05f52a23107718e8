"""A PySpark-native engine for indexing and querying a corpus of text and source files."""
