"""plainlake: a PySpark-native engine for versioned relational snapshots."""

__version__ = "0.1.0"
