"""plans of rowkin."""
