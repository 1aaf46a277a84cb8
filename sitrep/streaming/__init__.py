"""Structured Streaming jobs over the same operators the batch job uses."""
