"""Recipes over folders into which files arrive."""
