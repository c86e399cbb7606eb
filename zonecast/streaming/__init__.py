"""The jobs: sources, the same transforms as for tables, sinks."""
