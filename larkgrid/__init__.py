"""larkgrid: flight-log, point-cloud and reconstruction analytics on PySpark."""

__version__ = "0.1.0"
