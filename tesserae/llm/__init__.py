"""Operators for training-data pipelines: output, encoding, scoring, scanning, joining and mixing."""
