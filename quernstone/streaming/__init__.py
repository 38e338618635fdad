"""quernstone.streaming."""
