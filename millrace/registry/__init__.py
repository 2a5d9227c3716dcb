"""Every operator as a query over the supplied tables, with its SQL counterpart.

Each module has ``QUERIES`` (name -> function of session and folder) and
``ORACLE`` (name -> SQL). Names without SQL depend on the physical layout or
pick arbitrary rows.
"""

from millrace.registry import cleaning, encoding, files, layout, metrics, runs, scaling

MODULES = (scaling, cleaning, encoding, layout, metrics, runs, files)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
