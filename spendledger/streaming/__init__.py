"""Optional: extracts that keep arriving are loaded as they land."""
