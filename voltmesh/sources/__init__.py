"""Cutouts, dataset readers and configuration catalogs."""
