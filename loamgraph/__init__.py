"""loamgraph: Spark-native analysis of source trees and text corpora.

Every operator is a function from DataFrames to a DataFrame; nothing here runs
a query by itself unless its docstring says so (closures and components loop).
"""

__version__ = "0.1.0"
