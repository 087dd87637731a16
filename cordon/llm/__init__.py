"""Training-data operators: sharding, deduplication, extraction, scoring, mixing and tokenisation."""
