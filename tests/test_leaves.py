"""Leaves of JSON columns against a plain recursive walk."""
import json
import re
from collections import Counter

from lethe.operators.leaves import json_leaves

VALUES = ['{"a": 1, "b": {"c": "x@y.org", "d": [1, {"e f": null}, "t"]}, "g": {}}', '[[1, 2], [], ["z", [true]]]',
          '"scalar"', "12", "not json {", "", None, "{}", '{"é": "v", "a.b": 2}', '{"a": 1}', '{"a": 1}',
          "[" * 30 + '"deep"' + "]" * 30]


def walk(v, path="$"):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walk(x, path + (f".{k}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", k) else f'."{k}"'))
    elif isinstance(v, list):
        for x in v:
            yield from walk(x, path + "[*]")
    else:
        yield path, v if isinstance(v, str) or v is None else json.dumps(v)


def test_leaves_are_those_of_a_recursive_walk(spark):
    df = spark.createDataFrame(list(enumerate(VALUES)), "key long, path string")  # names that clash
    want = Counter()
    for i, t in enumerate(VALUES):
        if t is None:
            continue
        try:
            leaves = list(walk(json.loads(t)))
        except ValueError:
            leaves = [("$", t)]
        want.update((i, p, x) for p, x in leaves)
    got = Counter((r[0], r[1], r[2]) for r in json_leaves(df, "path", ["key"]).collect())
    assert got == want


def test_no_rows_no_leaves(spark):
    df = spark.createDataFrame([], "id long, j string")
    assert json_leaves(df, "j", ["id"]).collect() == []


def test_hits_by_path(spark):
    from lethe.plans.discovery import pii_scan_leaves
    t = spark.createDataFrame([('{"to": ["a@x.org", "none"], "id": 7}',), ('{"to": ["b@y.org"], "born": "1990-02-03"}',),
                               ('{"tax": "123-45-6789"}',), (None,)], "j string")
    got = {r["path"]: r for r in pii_scan_leaves({"t": t}, {"t": ["j"]}).collect()}
    assert set(got) == {"$.to[*]", "$.id", "$.born", "$.tax"}
    assert (got["$.to[*]"]["leaves"], got["$.to[*]"]["email_hits"], got["$.to[*]"]["email_share"]) == (3, 2, 0.666667)
    assert got["$.born"]["date_hits"] == got["$.tax"]["ssn_hits"] == 1 and got["$.id"]["email_hits"] == 0
