"""Registered queries: each operator applied to the provided tables, with its SQL."""
