"""Readers of files into typed DataFrames."""
