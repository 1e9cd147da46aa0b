"""plans of runlens."""
