"""tickloom: quantitative market research and corpus preparation on PySpark."""
