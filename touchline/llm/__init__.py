"""Training-data operators: cleaning, deduplication, tokens and scores of text corpora."""
