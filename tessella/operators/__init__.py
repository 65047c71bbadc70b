"""Operators over rasters, tiles, components, points and transforms."""
