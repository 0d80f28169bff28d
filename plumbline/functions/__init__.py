"""Column functions: text to tokens, vectors, hashes, strict value parsing. All stay inside the JVM."""
