"""Query plans and their oracle SQL."""
