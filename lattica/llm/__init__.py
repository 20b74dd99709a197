"""Training-data operators: deduplication, decontamination, formatting, scoring, mixing and storage."""
