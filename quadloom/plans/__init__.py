"""Rule compilation: from rule tables to cell plans."""
