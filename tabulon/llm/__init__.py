"""Training-data operators: filtering, scoring, tokenising, deduplicating and packing text corpora."""
