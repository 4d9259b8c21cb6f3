"""florilege: statements about groups of people, gathered from text with Spark DataFrames."""
