"""quernstone.operators."""
