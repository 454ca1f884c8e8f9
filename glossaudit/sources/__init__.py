"""Readers that turn landed pages, sitemaps and phrase files into DataFrames."""
