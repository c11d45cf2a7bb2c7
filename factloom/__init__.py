"""factloom: code-intelligence facts as Spark DataFrames, and the operators over them."""
