"""Operators over long tables: one row a cell, with index columns."""
