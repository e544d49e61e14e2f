"""Sources: files, message bus, change logs and the analytic tables."""
