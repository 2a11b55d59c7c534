"""strandline: genome-cohort analytics and large-corpus data preparation on Spark DataFrames."""
