"""Training-data operators: near-duplicates, packing, search, tokens, licences, quality, HTML and personal data."""
