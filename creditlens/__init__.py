"""creditlens — agricultural-credit analytics on PySpark.

Forty parameterised business reports over a six-table credit-cooperative
schema (branches, members, accounts, credit products, loans, instalments),
built only from DataFrame/SQL expressions so that Catalyst and AQE plan
them.  Layout:

* ``sources``   — schemas, the ``Tables`` bundle, readers and the mapping
                  of the driver's star schema onto the six tables.
* ``functions`` — column-expression helpers (safe division, month keys,
                  closed-form tiles, report types).
* ``operators`` — reusable relational building blocks (loan chain,
                  evidence joins, top-n, exact global ranking, conditional
                  totals, dispersion, data-quality audits).
* ``plans``     — the forty reports and the catalogue of registered queries.
* ``streaming`` — intentionally empty: the reports are batch questions over
                  tables; there is no stream, watermark or state to model.
"""

from creditlens.sources.tables import Tables

__all__ = ["Tables"]
