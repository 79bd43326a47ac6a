"""streaming of barline."""
