"""streaming of runlens."""
