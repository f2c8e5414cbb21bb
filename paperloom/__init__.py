"""Document analytics on Spark: containers, one normalized document model, and queries over it."""

__version__ = "0.1.0"
