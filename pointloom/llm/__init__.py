"""Training-data operators: deduplication, fingerprints, packing, scoring, mixing and archives."""
