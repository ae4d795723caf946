"""orebody: topology analysis of embedding collections on PySpark."""

__version__ = "0.1.0"
