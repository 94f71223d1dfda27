"""Training-data operators over documents, embeddings and pages."""
