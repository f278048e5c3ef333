"""PySpark analytics."""
