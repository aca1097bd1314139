"""Frame, plane, block and byte-stream analytics written as Spark DataFrame jobs."""

__version__ = "0.1.0"
