"""Point-table analytics on PySpark: labelled clouds, stem maps and their upkeep at scale."""

__version__ = "0.1.0"
