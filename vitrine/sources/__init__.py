"""vitrine.sources."""
