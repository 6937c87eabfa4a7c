"""Sources (driver tables, panel views, file readers) and sinks."""
