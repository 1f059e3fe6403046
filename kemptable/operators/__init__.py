"""DataFrame operators: counts, numbers, profiles, order, cleaning, quality."""
