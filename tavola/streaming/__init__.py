"""Structured Streaming jobs over the prediction log and score requests."""
