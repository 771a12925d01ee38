"""ledgerlens: a PySpark-native analytics engine for provenance-tagged document data."""
