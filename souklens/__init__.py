"""Catalogue analytics on Spark: DataFrame-to-DataFrame operators for crawled shop pages and product tables."""
