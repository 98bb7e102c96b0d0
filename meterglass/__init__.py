"""meterglass: a Spark-native engine for radio telemetry tables and device anomaly models."""
