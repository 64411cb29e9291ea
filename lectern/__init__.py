"""lectern: document analytics and retrieval over course archives, written as Spark DataFrame plans."""

__version__ = "0.1.0"
