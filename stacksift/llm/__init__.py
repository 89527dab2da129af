"""Operators of a training-data pipeline on documents, conversations, pages and vectors."""
