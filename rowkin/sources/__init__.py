"""sources of rowkin."""
