"""Every registered query with an SQL twin gives the twin's rows on the smallest tables; every other one gives the rows pinned in pinned.json.

A pinned result is the number of rows and a digest of them in order of their values: it shows that a result changed, and it was looked at when it was pinned. To pin anew: PIN=1 python -m pytest tests/test_oracle.py
"""

import hashlib
import json
import os

import pytest

from leadloom.plans import ORACLES, QUERIES
from tests.oracle import connect, differences, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PINNED = os.path.join(os.path.dirname(__file__), "pinned.json")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def pinned():
    with open(PINNED) as f:
        known = json.load(f)
    yield known
    if os.environ.get("PIN"):
        with open(PINNED, "w") as f:
            json.dump(dict(sorted(known.items())), f, indent=1)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, pinned, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert differences(df, ORACLES[name], con) == ""
        return
    rows = rows_of(df.columns, df.collect())
    got = [len(rows), hashlib.sha256("\n".join(map(repr, [sorted(df.columns), *rows])).encode()).hexdigest()[:16]]
    if os.environ.get("PIN"):
        pinned[name] = got
    elif SF.endswith("sf0.001"):
        assert got == pinned[name] and got[0] > 0
    else:
        assert got[0] > 0
