"""PySpark operators that turn raw workplace-tool records into people-centred metrics."""

__version__ = "0.1.0"
