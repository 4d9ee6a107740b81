"""Rules, and how they become plans."""
