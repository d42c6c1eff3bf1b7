"""Part of quirewise."""
