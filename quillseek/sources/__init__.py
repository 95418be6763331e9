"""Collections, keys and indexes."""
