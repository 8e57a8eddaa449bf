"""Training-data operators: search, archives, filters, joins, mixing, packing and dedup."""
