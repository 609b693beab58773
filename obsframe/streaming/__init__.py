"""Streams of measurements: moments of time windows, which merge like those of steps."""
