"""Training-data operators: clean, de-duplicate, mix, search and encode corpora."""
