"""Whole views, composed from the operators."""
