"""Vehicle-tracking analytics on PySpark: clean, load, derive, reconcile and read positions and stops."""
