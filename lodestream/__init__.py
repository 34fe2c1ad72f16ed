"""lodestream: a PySpark-native engine for media libraries, intervals and corpora."""
