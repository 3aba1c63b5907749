"""streaming of faintline."""
