"""Free-text notes to labelled corpora and evaluated classifiers, on Spark DataFrames."""
