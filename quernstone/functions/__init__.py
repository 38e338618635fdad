"""quernstone.functions."""
