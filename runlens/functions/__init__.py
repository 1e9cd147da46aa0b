"""functions of runlens."""
