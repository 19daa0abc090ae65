"""Datasets and reports composed of the operators."""
