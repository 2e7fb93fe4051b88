"""Structured Streaming over training logs, detections and metrics."""
