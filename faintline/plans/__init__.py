"""plans of faintline."""
