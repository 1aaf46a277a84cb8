"""Readers and writers: dimensions, feeds, topics, versioned tables, exports."""
