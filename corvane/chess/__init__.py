"""Rules of chess in plain Python, and the vectorised functions that apply them to distinct values."""
