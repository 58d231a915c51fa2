"""Listing-price analytics on Spark: every operator is DataFrame(s) in, DataFrame out."""
