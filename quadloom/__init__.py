"""quadloom: rule-based translation of message graphs, expressed as Spark DataFrame plans."""
