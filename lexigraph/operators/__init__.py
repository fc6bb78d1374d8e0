"""lexigraph.operators."""
