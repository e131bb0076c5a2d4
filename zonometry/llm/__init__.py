"""Operators for training-data pipelines: documents in, documents or decisions out."""
