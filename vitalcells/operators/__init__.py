"""DataFrame operators: cohorts, descriptive tables, profiles, reshapes, cells and model fits."""
