"""tiltkit.plans."""
