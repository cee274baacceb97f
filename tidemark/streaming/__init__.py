"""The same streams under Structured Streaming."""
