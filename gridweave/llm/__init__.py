"""Training-data operators: one module per operator, each with a general interface.

Modules are imported one by one; nothing outside this subpackage imports them.
"""
