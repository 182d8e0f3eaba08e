"""Functions of the page and book engine."""
