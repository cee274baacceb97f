"""Ordered data streams with cursors, partitions and incremental projections, on Spark."""
