"""surveil.sources."""
