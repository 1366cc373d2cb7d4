"""evtab: annotated-event tables as Spark DataFrame jobs.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or a
``Column`` expression), so pipelines compose with ``df.transform``.
"""

__version__ = "0.1.0"
