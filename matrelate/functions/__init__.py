"""Matrix functions: iterations over matrix products, written once for distributed and local matrices."""
