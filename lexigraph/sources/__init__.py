"""lexigraph.sources."""
