"""Query registry of the core library."""
