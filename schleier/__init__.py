"""Finding, resolving, masking and scoring sensitive spans in document tables, on Spark."""

__version__ = "0.1.0"
