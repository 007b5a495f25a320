"""Column functions: everything here is Column in, Column out."""
