"""Field assessment on Spark: entries from files, databases and tables, scored field by field for review."""

from .operators.config import Config
from .operators.planner import BatchOptions, preview
from .operators.scan import FieldResult, Result, Store, scan, scan_frame
from .sources.readers import Entry, reader_for

__all__ = ["BatchOptions", "Config", "Entry", "FieldResult", "Result", "Store", "preview", "reader_for", "scan", "scan_frame"]
