"""DataFrame-in, DataFrame-out operators (profiling, KPIs, insights, questions,
dialogue log, training preparation, models, evaluation, scoring)."""
