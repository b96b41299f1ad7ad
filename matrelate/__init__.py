"""matrelate: sparse-matrix analytics with matrices held as relations on Spark."""
