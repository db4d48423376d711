"""Training-data operators over document and conversation tables.

Nothing outside this subpackage imports it; the queries that use it are in
``assayer.llm.queries`` and are added by ``__spark_entry__`` when it is there.
"""
