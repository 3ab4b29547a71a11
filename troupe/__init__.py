"""troupe: a PySpark-native engine that profiles entities by the items they are credited with."""
