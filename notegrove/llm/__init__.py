"""Operators for large training-text pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator with its
own general interface; :mod:`notegrove.llm.queries` wires them to the fixed tables.
"""
