"""DataFrame operators over mutation logs, tables and evidence."""
