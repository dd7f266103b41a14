"""PySpark-native operators for case/control studies over interval-shaped data."""
