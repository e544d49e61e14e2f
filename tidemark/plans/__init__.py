"""Named queries built from the operators."""
