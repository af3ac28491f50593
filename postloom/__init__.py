"""postloom: a retrieval, memory and data-preparation engine for correspondence, on PySpark."""

__version__ = "0.1.0"
