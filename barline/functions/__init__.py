"""functions of barline."""
