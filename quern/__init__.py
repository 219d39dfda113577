"""quern: retrieval, evaluation and curation analytics expressed as Spark plans."""

__version__ = "0.1.0"
