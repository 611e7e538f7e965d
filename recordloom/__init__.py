"""recordloom: organise, reconcile and protect messy records with Spark DataFrames."""
