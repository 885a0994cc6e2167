"""Vector functions: as Spark columns, as numpy blocks, and codecs."""
