"""Column functions: text and amounts in, values out."""
