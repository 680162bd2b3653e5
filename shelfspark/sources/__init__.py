"""Sources and sinks: the catalogue view, CSV/JSON/Parquet readers, model and run stores."""
