"""DataFrame -> DataFrame operators over hazard events."""
