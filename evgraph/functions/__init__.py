from evgraph.functions import geometry, scores, text  # noqa: F401
