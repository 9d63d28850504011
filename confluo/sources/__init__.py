"""Sources and sinks: tables, station files, polygon files, wide exports, and adapters of the star-schema tables."""
