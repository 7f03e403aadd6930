"""Queries over the provided tables, each with its SQL counterpart."""
