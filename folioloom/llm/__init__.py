"""Training-data operators: search, deduplication, mixing, packing, extraction and storage."""
