"""Fund-flow tracing and wallet intelligence as PySpark DataFrame jobs."""

__version__ = "0.1.0"
