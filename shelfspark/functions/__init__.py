"""Column builders: null/division rules, engineered features, display text."""
