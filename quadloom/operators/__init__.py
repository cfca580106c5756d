"""Graph operators over quad tables and nested messages."""
