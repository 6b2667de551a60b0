"""Execution plans: iteration, strategies, and the profile-driven scheduler."""
