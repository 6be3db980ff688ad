"""Operators for building training corpora of text. Nothing else in the library imports this subpackage."""
