"""Column functions: numbers, dates, classes and text of the domain."""
