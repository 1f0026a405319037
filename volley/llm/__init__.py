"""Training-data operators: documents in, documents or per-document findings out."""
