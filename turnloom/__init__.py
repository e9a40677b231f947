"""turnloom: curation and evaluation of note-and-dialogue corpora on Spark DataFrames."""
