"""Training-data operators: deduplication, filtering, scoring, mixing, sharding."""
