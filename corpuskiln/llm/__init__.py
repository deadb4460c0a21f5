"""Training-data operators: extraction, language, duplicates, contamination, toxicity, mixing."""
