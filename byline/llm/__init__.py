"""Operators for preparing training text at scale, each over DataFrames of documents, pages or vectors."""
