"""Training-data operators: dedup, packing, sharding, scoring, decontamination and redaction."""
