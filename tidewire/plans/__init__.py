"""Query catalogues: names to callables and their oracle SQL."""
