"""Graph operators over edge and vertex tables."""
