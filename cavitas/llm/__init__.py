"""Training-data operators: ten numbered operators over documents, pages and vectors."""
