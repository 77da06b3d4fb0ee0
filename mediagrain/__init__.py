"""Catalogue analytics on Spark: operators over media-catalogue tables and streams."""
