"""Place-and-time analytics on Spark: pixels to zone panels, panels to statistics."""

__version__ = "0.1.0"
