"""surveil.operators."""
