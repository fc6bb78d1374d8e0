"""lexigraph.streaming."""
