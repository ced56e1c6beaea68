"""What several test modules use."""


def values(df, *columns):
    """Sorted row tuples of the named columns."""
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
