"""Readers, sinks and the genomics views over the driver tables."""
