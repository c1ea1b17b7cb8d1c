"""A knowledge-graph and retrieval engine on Spark: notes, search, graph, schema and change tracking as DataFrames."""
