"""Writers of tables that others read."""
