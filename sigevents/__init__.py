"""Spark jobs for window-scored event detection on long multichannel recordings."""
