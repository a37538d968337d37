"""Column functions: text, chunks, metadata, tokens, vectors and names."""
