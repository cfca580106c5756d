"""Sources and sinks: rule tables, rule documents, registry tables, topics."""
