"""Readers and writers of plain-text matrices, tensors and measurement cubes."""
