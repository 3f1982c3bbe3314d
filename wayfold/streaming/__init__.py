"""Tracks as they arrive: an extension beside the batch readers."""
