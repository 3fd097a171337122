"""Column functions: cleaning, name facts and display texts."""
