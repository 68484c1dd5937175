"""Named queries: plans made of the operators."""
