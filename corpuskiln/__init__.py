"""corpuskiln: curation of language-model training data as Spark DataFrames."""
