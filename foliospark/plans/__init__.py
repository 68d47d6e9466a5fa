"""Query catalogue: every operator bound to the shared tables."""
