"""A PySpark-native text-analytics engine: score, select, parse, repair and report."""
