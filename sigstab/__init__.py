"""sigstab: feature ranking, signature search and stability analysis on Spark DataFrames."""
