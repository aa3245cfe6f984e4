"""Sources and sinks: packages, chunk files, registries."""
