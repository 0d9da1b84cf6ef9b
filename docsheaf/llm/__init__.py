"""Training-data operators over whole corpora. Nothing else in the package imports this folder."""
