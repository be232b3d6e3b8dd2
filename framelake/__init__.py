"""Batch and streaming jobs over an index of video frames."""
