"""Adapters that read tables as audit data: logs, relations and versioned registries."""
