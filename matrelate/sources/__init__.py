"""Readers and writers of matrices, and matrices made from tables."""
