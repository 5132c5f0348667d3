"""Training-data operators: thirteen independent operators and the queries that apply them to the given tables.

Nothing outside this subpackage imports it. Functions run in Python workers are sent by value, so a worker needs
no installed copy of the package.
"""

from clauselake.runtime import ship_by_value

ship_by_value(__name__)
