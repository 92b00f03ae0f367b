"""Operators for training-data pipelines over documents, pages and token ids."""
