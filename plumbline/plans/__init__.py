"""Queries as trees: parsing and limits (nodes), requests, and their translation into Spark plans (compiler, paging)."""
