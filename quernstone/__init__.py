"""quernstone: a PySpark-native engine that builds, cleans and measures fine-tuning corpora."""
