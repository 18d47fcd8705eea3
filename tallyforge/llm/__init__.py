"""Training-data operators: quality, tokens, deduplication, packing and formatting."""
