import os
import re
import warnings

import pytest

import __spark_entry__ as entry
from tests import compare

SMALL = "/root/testdata/sf0.001"

# Operator ids of the inventory.
IDS = (
    [f"s{i}" for i in range(1, 8)] + [f"k{i}" for i in range(1, 10)] + [f"p{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13)]
    + [f"j{i}" for i in range(1, 17)] + [f"a{i}" for i in range(1, 29)] + [f"w{i}" for i in range(1, 10)]
    + [f"t{i}" for i in range(1, 7)] + [f"u{i}" for i in range(1, 5)] + [f"f{i}" for i in (1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, 18)]
    + [f"st{i}" for i in (*range(1, 16), 17, 18, 19)] + [f"e{i}" for i in range(1, 16)]
)

# One per family by default; METERFOLD_ALL=1 compares every query.
SAMPLE = ["flow", "s1", "k5", "p4", "j5", "j8", "j14", "a2", "a4", "a8", "a17", "a23", "a28", "w5", "w7", "w8_split", "t2", "u3", "f7", "st3", "st10", "e9", "e15"]


def test_every_operator_is_registered():
    assert not set(IDS) - entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert set(IDS) <= entry.oracle_sql().keys()


@pytest.mark.parametrize("missing,left_out", [("meterfold.llm", True), ("a_package_of_its_own", True), ("meterfold.session", False)])
def test_the_optional_part_may_be_missing(monkeypatch, missing, left_out):
    def fails(name):
        raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)

    monkeypatch.setattr(entry.importlib, "import_module", fails)
    if left_out:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            assert entry._optional("meterfold.llm.queries") is None
    else:
        with pytest.raises(ModuleNotFoundError):
            entry._optional("meterfold.llm.queries")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    return compare.connect(SMALL)


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()) if os.environ.get("METERFOLD_ALL") else SAMPLE)
def test_equals_sql(spark, duck, key):
    got = compare.spark_rows(entry.queries()[key](spark, SMALL))
    assert compare.difference(got, compare.duck_rows(duck, entry.oracle_sql()[key])) is None


def test_flagship(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    df = entry.entry(spark)
    assert df.columns == ["time", "region_name", "type", "min_value", "max_value", "avg_value", "avg_sum", "avg_count"]
    assert df.count() > 0


def test_no_driver_side_gathering_in_operators():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "meterfold")
    banned = re.compile(r"localCheckpoint|crossJoin|toPandas|broadcast\(")
    for folder, _, files in os.walk(root):
        for name in files:
            if name.endswith(".py"):
                assert not banned.search(open(os.path.join(folder, name)).read()), name
