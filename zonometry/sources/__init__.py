"""Readers that turn landed files into typed DataFrames."""
