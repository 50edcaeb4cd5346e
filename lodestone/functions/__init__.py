"""Native column expressions."""
