"""Training-data operators: quality, personal data, tokenization, language, mixing, media, dedup, scoring, pages."""
