"""Operators for large-scale training data; the rest of the library does not depend on them."""
