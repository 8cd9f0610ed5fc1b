"""File sources, layouts and the table store."""
