"""A PySpark-native engine for evidence-grounded operational memory."""
