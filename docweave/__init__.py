"""docweave: corpus ingestion, retrieval and request analytics as Spark DataFrame functions.

Every public operator is a plain ``DataFrame -> DataFrame`` (or column) function so it
composes with ``DataFrame.transform`` and works unchanged on batch and streaming frames.
"""

__version__ = "0.1.0"
