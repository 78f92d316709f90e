"""Registered queries."""


def all_queries():
    """All queries of the library and their oracles."""
    from decilens.plans import more, queries, reports, shapes

    assert more and reports and shapes
    return queries.QUERIES, queries.ORACLES
