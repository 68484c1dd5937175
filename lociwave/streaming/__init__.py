"""Structured Streaming form of the bounded-lateness pileup."""
