"""Training-data operators: deduplication, filters, secrets, mixing, tokens and chat text."""
