"""Training-data operators: quality, decontamination, counting, near-duplicates, scoring, ordering and packing."""
