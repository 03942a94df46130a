"""A knowledge-graph analytics engine on Spark: extract, merge, cluster, analyse, query and render property graphs."""

from .model import PropertyGraph

__all__ = ["PropertyGraph"]
