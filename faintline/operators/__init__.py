"""operators of faintline."""
