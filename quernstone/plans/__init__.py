"""quernstone.plans."""
