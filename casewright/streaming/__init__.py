"""Stream forms of batch operators."""
