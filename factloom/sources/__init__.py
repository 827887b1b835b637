"""Event log, lake, connectors and exports."""
