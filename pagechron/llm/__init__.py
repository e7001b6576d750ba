"""Training-data operators: scoring, extraction, dedup, packing and archives."""
