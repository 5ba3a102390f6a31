"""Part of the tablesmith engine."""
