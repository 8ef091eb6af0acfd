"""Training-data operators: filtering, deduplication, scoring, mixing and packing of text corpora."""
