"""surveil.streaming."""
