"""Column expressions: vectors, text, filing metadata, evidence gating, and the few Python functions."""
