"""keyloom: a Spark-native engine for sharded indexes of hierarchical string keys.

Everything is a lazy DataFrame planned by Catalyst.  See README.md.
"""

__version__ = "0.1.0"
