"""Training-data operators: archive, mixing, scoring, packing, rules, private data, duplicates, search, urls."""
