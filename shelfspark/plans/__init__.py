"""Reusable plan shapes that stay distributed at scale, and the query registry.

- ``windows``: cumulative sums over a global order (``running_sums``) and the next row
  in a sequence (``next_row``) without a one-task window per hot key.
- ``grid``: dense row x column grids (long form by exploding the column domain, wide
  form by a checked pivot).
- ``quantiles``: exact interpolated quantiles and moments from value frequencies.
- ``reuse``: write a small aggregate once when several readers need it.
- ``joins``: broadcast a small aggregate only after checking its size.
- ``registry`` / ``queries_*``: the named queries of ``__spark_entry__`` with their
  DuckDB oracles.
"""
