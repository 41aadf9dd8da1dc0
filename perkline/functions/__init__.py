"""Column functions: cleaning, typing, money."""
