"""barline: analytics over ordered bars as lazy Spark plans."""
