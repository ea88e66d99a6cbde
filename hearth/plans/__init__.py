"""Recipes, model drivers, cross-validation and experiments."""
