"""Training-data operators: deduplication, decontamination, mixing, scoring and formatting."""
