"""Point-in-time analytics over versioned document collections, declared as Spark plans."""

__version__ = "0.1.0"
