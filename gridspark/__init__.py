"""Spark operators over gridded atmosphere cubes and vertical-column tables."""
