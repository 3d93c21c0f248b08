"""End-to-end flows and the command line."""
