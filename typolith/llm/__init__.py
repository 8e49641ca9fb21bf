"""Training-data operators: extraction, filtering, dedup, scoring and mixing of text corpora."""
