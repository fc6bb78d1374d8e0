"""lexigraph.functions."""
