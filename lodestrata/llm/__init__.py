"""Training-data operators: cleaning, de-duplication, search, mixing and encoding of text corpora."""
