"""Column functions: text, URLs, hashes, vectors, time."""
