"""Detection and hunting analytics over security event tables, as Spark DataFrame transforms."""

__version__ = "0.1.0"
