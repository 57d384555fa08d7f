"""surveil.functions."""
