"""lociwave: population-genomics correlation profiles as Spark DataFrame plans."""

__version__ = "0.1.0"
