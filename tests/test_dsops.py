from pyspark.sql import functions as F

from snipflow.operators import dsops

LOC = "array<struct<name:string,kind:string,items:array<string>,repr:string>>"


def _ops(spark, rows):
    df = spark.createDataFrame(rows, f"line_text string, locals {LOC}")
    return {r["line_text"]: r for r in dsops.detect_operations(df).collect()}


def L(name, items, kind="list"):
    return (name, kind, [str(i) for i in items], None)


def S(name, value):
    return (name, "int", None, str(value))


def test_branches_and_fallbacks(spark):
    rows = [
        ("node = queue.popleft()", [L("queue", [3, 4, 5])]),
        ("x = q.pop(0)", [S("v", 1)]),
        ("top = stk.pop()", [L("result", [1]), L("stk", [7, 8])]),
        ("v = other.pop()", [L("result", [1]), L("other", [2, 9])]),
        ("y = res.pop()", [L("res", [1])]),
        ("queue.append(42)", [L("queue", [])]),
        ("frontier.append(node)", [S("node", 6)]),
        ("stack.append(1.5)", [L("stack", list(range(25)))]),
        ("stk.push(v)", [L("pile", [1]), S("v", 3)]),
        ("queued.append(1)", [L("queued", [1])]),
        ("   ", [L("queue", [1])]),
    ]
    o = _ops(spark, rows)
    d = o["node = queue.popleft()"]
    assert (d["operation"], d["value"], d["front"], d["rear"], d["active_indices"]) == ("dequeue", "3", 0, 2, "[0]")
    assert d["log"] == "Dequeued 3 from queue. Queue is now: [4, 5]"
    assert o["x = q.pop(0)"]["log"] == "Dequeued from queue."
    p = o["top = stk.pop()"]
    assert (p["value"], p["top"], p["log"]) == ("8", 1, "Popped 8 from stack. Stack is now: [7]")
    assert o["v = other.pop()"]["value"] == "9"
    assert o["y = res.pop()"]["log"] == "Popped from stack."
    e = o["queue.append(42)"]
    assert (e["value"], e["front"], e["rear"], e["active_indices"]) == ("42", -1, -1, "[]")
    assert e["log"] == "Enqueued 42 to queue. Queue is now: []"
    assert o["frontier.append(node)"]["log"] == "Enqueued 6 to queue."
    s = o["stack.append(1.5)"]
    assert s["value"] == "1.5" and s["top"] == 24 and s["data"].count(",") == 19
    assert o["stk.push(v)"]["log"] == "Pushed 3 to stack."
    assert o["queued.append(1)"]["operation"] is None
    assert o["   "]["operation"] is None


def test_line_text_out_of_range(spark):
    runs = spark.createDataFrame([(1, "a\r\nb\x0bc\n")], "run_id long, code string")
    steps = spark.createDataFrame([(1, i) for i in range(1, 6)], "run_id long, line_number int")
    got = {r["line_number"]: r["line_text"] for r in dsops.attach_line_text(steps, runs).collect()}
    assert got == {1: "a", 2: "b", 3: "c", 4: "", 5: ""}


def test_locals_bounds(spark):
    long_text = "x" * 1500
    loc = [("__name__", "str", None, "__main__"), ("s", "str", None, long_text),
           ("big", "list", [str(i) for i in range(400)], None), ("small", "list", [str(i) for i in range(60)], None),
           ("collections", "module", None, "<module>")]
    df = spark.createDataFrame([(loc,)], f"locals {LOC}")
    r = df.select(dsops.sanitise_locals(F.col("locals")).alias("l")).collect()[0]["l"]
    by = {x["name"]: x for x in r}
    assert set(by) == {"s", "big", "small"}
    assert by["s"]["repr"] == "x" * 1000 + "... (truncated)"
    assert by["big"]["kind"] == "repr" and by["big"]["repr"].endswith("... (truncated)")
    assert len(by["small"]["items"]) == 50


def test_argument_parsing(spark):
    rows = [
        ("stack.append('hello')", [L("stack", [1])]),
        ("stack.append(+7)", [L("stack", [1])]),
        ("stack.append(2.)", [L("stack", [1])]),
        ("stack.append(007)", [L("stack", [1])]),
        ("stack.append( xs )", [L("stack", [1]), L("xs", [1, 2])]),
        ("queue.append()", [L("queue", [3])]),
        ("stack.append(123456789012345678901234567890)", [L("stack", [])]),
    ]
    o = _ops(spark, rows)
    assert o["stack.append('hello')"]["value"] == "hello"
    assert o["stack.append(+7)"]["value"] == "7"
    assert o["stack.append(2.)"]["value"] == "2.0"
    assert o["stack.append(007)"]["value"] == "7"
    assert o["stack.append( xs )"]["value"] == "[1, 2]"
    q = o["queue.append()"]
    assert q["value"] == "None" and q["log"] == "Enqueued None to queue. Queue is now: [3]"
    assert o["stack.append(123456789012345678901234567890)"]["value"] == "123456789012345678901234567890"


def test_text_by_kind(spark):
    rows = [
        ("stack.append(t)", [L("stack", [1]), L("t", [1], "tuple")]),
        ("stack.append(tt)", [L("stack", [1]), L("tt", [1, 2], "tuple")]),
        ("stack.append(d)", [L("stack", [1]), L("d", [1, 2], "deque")]),
        ("stack.append(e)", [L("stack", [1]), L("e", [], "set")]),
        ("stack.append(1_000)", [L("stack", [1])]),
        ("x = queue.popleft()", [L("queue", ["'a'", '"it\'s"'], "deque")]),
        ("y = stack.pop()", [L("stack", ["'a'", r"'b\\c'"])]),
    ]
    o = _ops(spark, rows)
    assert o["stack.append(t)"]["value"] == "(1,)"
    assert o["stack.append(tt)"]["value"] == "(1, 2)"
    assert o["stack.append(d)"]["value"] == "deque([1, 2])"
    assert o["stack.append(e)"]["value"] == "set()"
    assert o["stack.append(1_000)"]["value"] == "1000"
    assert o["x = queue.popleft()"]["log"] == """Dequeued a from queue. Queue is now: ["it's"]"""
    assert o["y = stack.pop()"]["log"] == r"Popped b\c from stack. Stack is now: ['a']"


def test_deque_and_long_tuple_bounds(spark):
    loc = [L("d", [1, 2], "deque"), L("t", list(range(400)), "tuple"), L("u", [1], "tuple")]
    df = spark.createDataFrame([(loc,)], f"locals {LOC}")
    by = {x["name"]: x for x in df.select(dsops.sanitise_locals(F.col("locals")).alias("l")).collect()[0]["l"]}
    assert by["d"]["kind"] == "repr" and by["d"]["repr"] == "deque([1, 2])"
    assert by["t"]["repr"].startswith("(0, 1, ") and by["t"]["repr"].endswith("... (truncated)")
    assert by["u"]["kind"] == "tuple" and by["u"]["items"] == ["1"]
