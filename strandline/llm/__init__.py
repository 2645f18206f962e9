"""Training-data operators: search, tokenizing, sharding, media, deduplication, quality, packing, language and privacy."""
