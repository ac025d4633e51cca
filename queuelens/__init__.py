"""queuelens - waiting-list analytics written as PySpark DataFrame plans."""

__version__ = "0.1.0"
