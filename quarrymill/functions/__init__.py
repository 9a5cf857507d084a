"""Column builders: cleaning, corruption and display."""
