"""functions of faintline."""
