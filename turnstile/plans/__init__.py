"""Recipes and the registered query catalog."""
