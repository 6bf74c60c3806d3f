"""tidemark: capture-index analytics and text pipelines on Spark DataFrames."""
