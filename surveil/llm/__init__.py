"""Training-data operators: PII, near and exact duplicates, mixing, packing, quality, search, LM scores."""
