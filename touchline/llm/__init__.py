"""Training-data operators: decontamination, deduplication, language, quality, toxicity, URLs, tokens."""
