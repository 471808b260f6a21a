"""Spark-native analytics over catalogues of Earth-observation tiles."""
