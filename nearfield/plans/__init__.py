"""The library's own queries over the test tables, and their SQL."""
