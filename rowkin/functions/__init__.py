"""functions of rowkin."""
