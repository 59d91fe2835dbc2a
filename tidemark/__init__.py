"""Point-in-time panel analytics as PySpark DataFrame operations."""
