"""streaming of rowkin."""
