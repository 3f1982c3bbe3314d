"""Readers of tracks, map extracts, tables, polygons and photos, as DataFrames."""
