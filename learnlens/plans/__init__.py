"""Composed results: the dashboard, its filtered views and role scopes."""
