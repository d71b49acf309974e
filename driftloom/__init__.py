"""driftloom: a PySpark-native engine for clustering drifting vector streams."""
