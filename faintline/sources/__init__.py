"""sources of faintline."""
