"""usagelake: a PySpark-native analytics engine for AI-tool usage data."""
