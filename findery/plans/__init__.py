"""Whole searches composed from the operators."""
