"""Every registered query of the library, with its SQL where SQL can express it."""

from . import calls, feeds, lives, memory, messages

_MODULES = [calls, messages, lives, memory, feeds]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
