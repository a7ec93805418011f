"""Building blocks and whole jobs composed from the operators."""
