"""operators of runlens."""
