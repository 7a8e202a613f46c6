"""Training-data operators: deduplication, decontamination, tokens, language, secrets, pages."""
