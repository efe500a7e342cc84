"""Column functions and numeric tails."""
