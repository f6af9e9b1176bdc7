"""Tables, deterministic key generators, and sinks for reports."""
