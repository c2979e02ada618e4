"""Column-level helpers: hashing, vectors, answer parsing, list metrics."""
