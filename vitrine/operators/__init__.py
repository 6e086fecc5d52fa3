"""vitrine.operators."""
