"""evgraph: evidence-graph analytics as DataFrame-to-DataFrame operators on PySpark."""
