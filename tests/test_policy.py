from snipflow.operators import policy


def test_screen_messages(spark):
    rows = [
        (1, "import os\nprint(1)\n", None),
        (2, "from . import x\nprint(x)\n", None),
        (3, "y = [].__class__\n", None),
        (4, "def f():\n    return 1\n", None),
        (5, "def f():\n    return 1\n", "print(f())"),
        (6, "   \n", None),
        (7, "def f(:\n", None),
        (8, "import collections.abc, heapq, json\nprint(1)\n", None),
        (9, "def f():\n    return 1\n", "eval('1')"),
        (10, "x = open('f')\nimport sys\n", None),
    ]
    runs = spark.createDataFrame(rows, "run_id long, code string, entry_call string")
    s = {r["run_id"]: r for r in policy.screen(runs).collect()}
    assert s[1]["policy_error"] == "Import of 'os' is not allowed. Only collections and heapq are available."
    assert s[2]["policy_error"] == "Relative imports are not allowed."
    assert s[3]["policy_error"] == "Access to dunder attributes is not allowed."
    assert s[4]["policy_error"] == policy.MSG_NO_CALL
    assert s[5]["screen_status"] == "ok"
    assert s[5]["run_text"] == "def f():\n    return 1\n\nprint(f())\n"
    assert s[6]["screen_status"] == "empty"
    assert s[7]["screen_status"] == "syntax_error" and s[7]["syntax_error"].startswith("Syntax error on line 1:")
    assert s[8]["policy_error"] == "Import of 'json' is not allowed. Only collections and heapq are available."
    assert s[9]["policy_error"] == "Use of restricted name 'eval' is not allowed."
    # breadth-first: the import (depth 1) comes before the name inside the call (depth 3)
    assert s[10]["policy_error"] == "Import of 'sys' is not allowed. Only collections and heapq are available."
