"""Training-data operators: scoring, deduplication, scans, search, packing and output."""
