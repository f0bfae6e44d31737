"""Readers of landed raw records, and their normalisation into candidates."""
