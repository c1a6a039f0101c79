"""Readers of landed files, and parsers from raw documents to typed rows."""
