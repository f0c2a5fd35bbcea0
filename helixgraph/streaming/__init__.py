"""streaming of the evidence engine."""
