"""Writers for scored tables, payloads and dictionaries."""
