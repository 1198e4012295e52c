"""Training-data operators: sharding, quality, de-duplication, mixing, search, extraction, archives and packing."""
