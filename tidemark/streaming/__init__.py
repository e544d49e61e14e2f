"""Running stream plans: emission modes, stateful processors and metrics."""
