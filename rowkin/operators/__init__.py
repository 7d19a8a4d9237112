"""operators of rowkin."""
