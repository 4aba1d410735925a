import pytest
from pyspark.sql import functions as F

from golden import GOLDEN, SYNTAX_ERRORS
from snipflow.operators import features, parse, rules
from snipflow.schemas import FEATURE_BY_ID


@pytest.fixture(scope="module")
def golden_rows(spark):
    rows = [(k, v[0]) for k, v in GOLDEN.items()] + [(k, v) for k, v in SYNTAX_ERRORS.items()]
    # every snippet twice: duplicates keep their rows but parse once
    df = spark.createDataFrame(rows + rows, "name string, code string")
    good, rejects = features.build_features(df)
    est = rules.estimate(good)
    return {r["name"]: r for r in est.collect()}, rejects.collect()


def test_golden_features(golden_rows):
    got, _ = golden_rows
    for name, (_, expect, _) in GOLDEN.items():
        r = got[name]
        nonzero = {i: r[FEATURE_BY_ID[i]] for i in FEATURE_BY_ID if r[FEATURE_BY_ID[i]]}
        assert nonzero == {i: float(v) for i, v in expect.items()}, name


def test_golden_rules(golden_rows):
    got, _ = golden_rows
    for name, (_, _, rule_id) in GOLDEN.items():
        assert got[name]["rule_id"] == rule_id, name


def test_rejects(golden_rows):
    _, rejects = golden_rows
    names = sorted({r["name"] for r in rejects})
    assert names == sorted(SYNTAX_ERRORS)
    assert len(rejects) == 2 * len(SYNTAX_ERRORS)


def test_parse_once_per_distinct_snippet(spark):
    df = spark.createDataFrame([("a = 1\n",)] * 5 + [("b = 2\n",)], "code string")
    nodes = parse.parse_nodes(df)
    assert nodes.where("node_id = 0").count() == 2


def test_repartition_invariant(spark):
    rows = [(k, v[0]) for k, v in GOLDEN.items()]
    df = spark.createDataFrame(rows, "name string, code string")
    a, _ = features.build_features(df)
    b, _ = features.build_features(df.repartition(7))
    cols = ["name"] + list(FEATURE_BY_ID.values())
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0


def test_preorder_intervals(spark):
    df = spark.createDataFrame([(GOLDEN["round_trips"][0],)], "code string")
    n = parse.parse_nodes(df).collect()
    by = {r["node_id"]: r for r in n}
    for r in n:
        if r["parent_id"] is not None:
            p = by[r["parent_id"]]
            assert p["node_id"] < r["node_id"] <= p["end_id"]
            assert r["path"][-1] == r["parent_id"] and len(r["path"]) == r["depth"]


def test_nodes_are_not_shuffled(spark):
    """Nodes meet their children and ancestors on their own row: the only exchanges are the
    two of the texts before the parse."""
    import contextlib
    import io
    df = spark.createDataFrame([(v[0],) for v in GOLDEN.values()], "code string")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        features.wide_nodes(parse.parse_nodes(df)).explain()
    plan = text.getvalue().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 2 and "Join" not in plan


def test_parser_hands_on_small_batches(spark):
    """What a task holds is bounded by node rows, and only the columns asked for are built."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"sample_id": [str(k) for k in range(900)], "code": ["a = [1, 2, 3]\n"] * 900})
    out = list(parse._parse_batches(["sample_id", "kind"])(iter([batch] * 5)))
    assert sum(b.num_rows for b in out) == 7 * 4500 and max(b.num_rows for b in out) < parse.BATCH_ROWS + 100
    assert out[0].schema.names == ["sample_id", "kind"] and parse.BATCH_ROWS <= 10_000


def test_only_nodes_that_features_read_leave_the_parser(spark):
    """Nodes that no feature reads by themselves count as children and ancestors only; the
    features are those of all nodes, and a node's flags travel as one number."""
    codes = {v[0] for v in GOLDEN.values()} | {"x = y + 1\n", ""}
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    every = features.wide_nodes(parse.parse_nodes(df))
    kept = features.wide_nodes(parse.parse_nodes(df, keep=features.read_by_features))
    assert 2 * kept.count() < every.count()
    a, b = features.features_of(every), features.features_of(kept)
    assert a.count() == b.count() == len(codes) and a.exceptAll(b).count() == 0
    assert dict(kept.dtypes)["flags"] == "bigint" and not {"path", "s_left", "c_name_targets"} & set(kept.columns)


def test_validation_takes_errors_only(spark):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"sample_id": ["a", "b"], "code": ["a = [1, 2, 3]\n" * 9, "def (\n"]})
    out = list(parse._parse_batches(["sample_id", "kind"], parse.only_errors)(iter([batch])))
    assert [r for b in out for r in b.to_pylist()] == [{"sample_id": "b", "kind": "ParseError"}]


def test_tree_columns_against_a_walk(spark):
    """Ancestors, subtree ends and children, gathered over a batch of snippets, against each
    snippet's own tree; fields in an order of their own, a batch without a node that is kept."""
    import ast

    import pyarrow as pa
    codes = [v[0] for v in GOLDEN.values()] + ["", "def (\n", "x = " + "+".join(["a"] * 200) + "\n",
                                               "class A:\n  async def f(self, *, k=1, **o):\n    return {**o, 'k': [i async for i in k if i]}\n"]
    batch = pa.RecordBatch.from_pydict({"sample_id": [str(k) for k in range(len(codes))], "code": codes})
    names = ["path_names", "children", "sample_id", "path", "end_id", "path_fields", "node_id", "path_kinds", "kind", "field"]
    got = {}
    for b in parse._parse_batches(names)(iter([batch])):
        for r in b.to_pylist():
            got.setdefault(int(r["sample_id"]), []).append(r)
    for k, code in enumerate(codes):
        if code == "def (\n":
            assert [(r["kind"], r["path"], r["children"]) for r in got[k]] == [("ParseError", None, [])]
            continue
        expect, todo = [], [(ast.parse(code), None, [], [], [], [])]
        while todo:
            node, field, path, fields, kinds, names_of = todo.pop()
            below = [(c, f) for f, v in ast.iter_fields(node) for c in (v if isinstance(v, list) else [v])
                     if isinstance(c, ast.AST) and not isinstance(c, parse._FOLDED)]
            own = node.name if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
            size = sum(not isinstance(n, parse._FOLDED) for n in ast.walk(node))
            expect.append((len(expect), len(expect) + size - 1, type(node).__name__, field, path, fields, kinds, names_of, [f for _, f in below]))
            nid = expect[-1][0]
            todo += [(c, f, path + [nid], fields + [f], kinds + [type(node).__name__], names_of + [own]) for c, f in reversed(below)]
        seen = [(r["node_id"], r["end_id"], r["kind"], r["field"], r["path"], r["path_fields"], r["path_kinds"], r["path_names"],
                 [c["field"] for c in r["children"]]) for r in got[k]]
        assert seen == expect, code
    none = list(parse._parse_batches(["sample_id", "path", "children"], lambda kind, name, op: False)(iter([batch])))
    assert sum(b.num_rows for b in none) == 0
