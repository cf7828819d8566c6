"""Functions on keys."""
