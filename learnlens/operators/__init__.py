"""Relational operators of the dashboard: features, panels, recommendations,
filtered views, role scopes and data-quality checks."""
