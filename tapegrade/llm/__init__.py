"""Operators over text corpora and embeddings; nothing else in the library imports them."""
