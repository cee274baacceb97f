"""Streams, partitions and folds."""
