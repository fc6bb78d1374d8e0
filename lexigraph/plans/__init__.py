"""lexigraph.plans."""
