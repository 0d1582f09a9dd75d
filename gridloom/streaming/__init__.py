"""Streams over the grid: lines' states as they arrive, held against the static model."""
