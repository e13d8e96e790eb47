"""Declarative log queries and the DataFrame plans they become."""
