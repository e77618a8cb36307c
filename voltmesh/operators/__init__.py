"""Joins and aggregations over cutouts: weight products, overlays, rasters, rivers, lines."""
