"""Training-data operators: search, fingerprints, filters, packing, classifiers, tokenizing and dedup."""
