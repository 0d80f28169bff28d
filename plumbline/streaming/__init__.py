"""Writes: ordered changes folded into the next version of a collection, in batch or as a stream."""
