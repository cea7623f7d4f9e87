"""Training-data operators: fingerprints, language ID, decontamination, archives, safety and packing."""
