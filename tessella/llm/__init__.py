"""Training-data operators: deduplication, decontamination, scoring and tokenisation of text corpora."""
