"""A PySpark-native analytics engine for shell-command text."""
