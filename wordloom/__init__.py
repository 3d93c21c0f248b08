"""A PySpark-native engine for discovering and scoring clusters of time-aligned speech segments."""
