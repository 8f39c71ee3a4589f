"""Where spans come from: files of telemetry, dialects, and tables."""
