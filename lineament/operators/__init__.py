"""Relational, geometric, raster, graph and path operators."""
