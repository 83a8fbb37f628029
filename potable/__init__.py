"""potable: gettext translation catalogs as Spark tables.

Entry points: ``potable.plans.translate.translate`` (the whole job),
``potable.sources.po_text.po_scan`` / ``potable.sinks.po_compile`` (files),
``potable.streaming.incremental.incremental_worklist`` (new files), and the
registered queries in ``__spark_entry__``.
"""

__version__ = "0.1.0"
