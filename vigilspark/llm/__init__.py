"""Training-corpus operators: language ID, deduplication, secrets, tokens, packing, scoring."""
