"""Training-data operators: deduplication, extraction, scoring, tokenising, mixing."""
