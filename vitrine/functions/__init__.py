"""vitrine.functions."""
