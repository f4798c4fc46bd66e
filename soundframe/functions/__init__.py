"""Part of soundframe."""
