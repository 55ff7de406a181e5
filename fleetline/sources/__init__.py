"""Sources and sinks: static feeds, archives, keyed tables."""
