"""Part of rosterlake."""
