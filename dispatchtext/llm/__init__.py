"""Training-data operators: near-duplicates, token files, extraction, language, toxicity, media, sharding, packing, quality."""
