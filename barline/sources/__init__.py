"""sources of barline."""
