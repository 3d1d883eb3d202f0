"""Tables that arrive over time."""
