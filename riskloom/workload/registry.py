"""All registered queries: name -> (Spark function, SQL twin or None)."""

from riskloom.workload import deciding, learning, measuring, preparing, storing

QUERIES: dict = {}
for module in (preparing, measuring, deciding, learning, storing):
    clash = QUERIES.keys() & module.Q.keys()
    if clash:
        raise ValueError(f"query registered twice: {sorted(clash)}")
    QUERIES.update(module.Q)
