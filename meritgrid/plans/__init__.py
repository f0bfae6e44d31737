"""Whole queries put together from the operators, and the registry of all of them."""
