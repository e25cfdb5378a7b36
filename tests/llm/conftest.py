import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, *by):
    """All rows as dicts, in the order of some columns."""
    got = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(got, key=lambda r: tuple((r[b] is None, r[b]) for b in by)) if by else got
