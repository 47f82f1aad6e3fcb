"""corpusforge: corpus refinement and file-tree planning as Spark DataFrames."""
