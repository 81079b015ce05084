"""Text rules of the gate, in plain Python: what Arrow stages call for each document."""
