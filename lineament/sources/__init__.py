"""Views over stored tables and the sinks that write layers."""
