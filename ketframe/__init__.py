"""ketframe: a PySpark-native analytics engine for labelled vector and state tables."""
