"""Catalogue analytics on PySpark: search, listing, facets, digests, comparison, merging and ingest of record collections."""
