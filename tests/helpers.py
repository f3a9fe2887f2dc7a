"""Helpers shared by the tests."""


def rows(df, *order):
    """Rows as plain tuples, sorted."""
    found = [tuple(r) for r in df.collect()]
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))
