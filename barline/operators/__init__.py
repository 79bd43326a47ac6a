"""operators of barline."""
