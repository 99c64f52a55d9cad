"""quillspark: document preparation on Spark, from raw text to scored, linked chunks."""

__version__ = "0.1.0"
