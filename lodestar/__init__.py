"""Geotemporal record analytics expressed as Spark DataFrame plans."""
