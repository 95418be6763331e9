"""Standing searches over streams and indexes that grow from streams."""
