"""Composed jobs, the registered query catalog and the oracle SQL writer."""
