"""Streaming jobs over event logs and polled sources."""
