"""Column functions on sequences, pileups, codons and statistics."""
