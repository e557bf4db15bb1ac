"""Table preparation on PySpark: operators from one DataFrame to another."""

__version__ = "0.1.0"
