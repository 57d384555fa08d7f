"""surveil.plans."""
