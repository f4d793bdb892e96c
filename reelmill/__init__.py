"""reelmill: a PySpark-native analytics engine for a two-source film catalogue."""
