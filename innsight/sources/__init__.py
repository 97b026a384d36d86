"""Sources: tenant-scoped table scans and the control tables."""
