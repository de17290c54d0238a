"""Training-data operators: archives, search, filters, packing, near-duplicates, formatting, codecs and fingerprints."""
