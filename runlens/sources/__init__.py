"""sources of runlens."""
