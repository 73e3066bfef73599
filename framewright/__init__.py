"""Frame-sequence analytics on Spark: loops, picks, sheets, rules and exports as DataFrame plans."""
