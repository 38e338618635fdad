"""quernstone.sources."""
