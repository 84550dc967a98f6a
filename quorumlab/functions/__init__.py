"""Column functions: ``Column -> Column``, no shuffles, no Python workers."""
