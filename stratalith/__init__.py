"""PySpark-native analytics over block-structured archives and damage experiments."""
