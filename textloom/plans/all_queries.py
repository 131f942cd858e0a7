"""Imports every module of queries."""

from textloom.plans import corpus_queries, io_queries, language_queries, retrieval_queries, structure_queries, text_queries  # noqa: F401
