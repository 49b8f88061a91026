import json

from docquarry.llm import chat

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"add": {"a": ("number", True), "b": ("number", True)}, "say": {"text": ("string", True), "loud": ("boolean", False), "tags": ("array", False), "more": ("object", False), "n": ("integer", False)}}


def rows(spark, calls, results):
    out = chat.linked_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    return {(r.conv_id, r.call_id): r for r in out.collect()}


def test_links_and_canonical_json(spark):
    got = rows(spark, [(1, "x", 1, "add", '{"b": 2.50, "a" : 1}', []), (1, "y", 2, "say", '{"text":"q\\"\\u00e9\\n", "tags":[ 1,{"z":1,"y":2}]}', ["x"])], [(1, "x", 3, "3.5"), (1, "x", 4, "later"), (2, "y", 1, "other")])
    x, y = got[1, "x"], got[1, "y"]
    assert (x.status, x.n_results, y.status, y.n_results) == ("linked", 2, "unanswered", 0)
    assert x.json == '{"call":{"arguments":{"a":1,"b":2.5},"id":"x","name":"add"},"result":"3.5","status":"linked"}'
    assert y.json == json.dumps(json.loads(y.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(y.json)["call"]["arguments"] == {"text": 'q"é\n', "tags": [1, {"z": 1, "y": 2}]}


def test_violations(spark):
    cases = {"{": ["unparsable"], "{}": ["missing:a", "missing:b"], '{"a":"1","b":2}': ["type:a"], '{"a":1,"b":2,"c":3}': ["extra:c"], '{"a":null,"b":1e3}': ["type:a"]}
    got = rows(spark, [(i, "c", 0, "add", a, []) for i, a in enumerate(cases)] + [(90, "c", 0, "what", "{}", []), (91, "c", 0, None, "{}", []), (92, "c", 0, "say", None, []), (93, "c", 0, "say", '{"text":"","loud":true,"more":{},"n":1}', [])], [])
    for i, want in enumerate(cases.values()):
        assert got[i, "c"].problems == want
    assert [got[k, "c"].problems for k in (90, 91, 92, 93)] == [["unknown_tool"], ["unknown_tool"], ["unparsable"], []]
    assert all(json.loads(r.json) for r in got.values())


def test_order(spark):
    call = lambda c, i, t, on: (c, i, t, "add", '{"a":1,"b":1}', on)
    calls = [call(1, "a", 1, []), call(1, "b", 2, ["a"]), call(2, "a", 1, ["b"]), call(2, "b", 2, ["c"]), call(2, "c", 3, []), call(2, "d", 4, ["a", "nowhere"]), call(3, "a", 1, ["b"]), call(3, "b", 2, ["a"]), call(3, "c", 3, []), call(4, "s", 1, ["s"])]
    got = {k: r.level for k, r in rows(spark, calls, []).items()}
    assert got == {(1, "a"): 0, (1, "b"): 0, (2, "c"): 0, (2, "b"): 1, (2, "a"): 2, (2, "d"): 3, (3, "a"): None, (3, "b"): None, (3, "c"): 0, (4, "s"): None}


def test_odd_rows(spark):
    calls = [(None, "a", 1, "add", "{}", None), (1, None, 1, "add", "{}", None), (1, "a", None, "add", "{}", None), (1, "z", 1, "say", '{"text":"t"}', None), (1, "z", 1, "say", '{"text":"t"}', None), (1, "z", 2, "add", "{}", [None])]
    got = rows(spark, calls, [(1, "z", 1, None), (None, "z", 1, "x")])
    assert list(got) == [(1, "z")] and got[1, "z"].status == "linked" and json.loads(got[1, "z"].json)["result"] is None
    assert rows(spark, [], []) == {}
    turns = spark.createDataFrame([(1, 0, "user", None, 3), (1, 1, "assistant", "hé\n", 3), (1, 2, "user", "x" * 100_000, 3), (1, 3, "system", "s", 3), (1, 3, None, "s", 3)], "conv_id long, turn int, role string, text string, level int")
    out = chat.linked_calls(*chat.as_calls(turns), chat.REPLY).collect()
    assert sorted((r.call_id, r.status) for r in out) == [("t0", "linked"), ("t2", "unanswered")]


def canonically(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    return [r.c for r in df.select("i", chat.canonical("j").alias("c")).orderBy("i").collect()]


def test_canonical_numbers(spark):
    numbers = {"1.0": "1", "1e0": "1", "1E2": "100", "-0": "0", "-0.0e9": "0", "0.10": "0.1", "1.50E+1": "15", "12.5e-1": "1.25", "1e21": "1e+21", "1e20": "1" + "0" * 20, "123e-9": "1.23e-7", "0.000001": "0.000001", "1e-7": "1e-7", "-2.50": "-2.5", "1e400": "1e+400", "100": "100"}
    long = "12345678901234567890123456789012345678901234567891"
    numbers |= {long: long, long + "0": long[0] + "." + long[1:] + "e+50", "-" + long + ".50": "-" + long + ".5", "9" * 40 + "e-45": "0.00000" + "9" * 40, "1e9223372036854775807": "1e9223372036854775807", "1e-999999999999999": "1e-999999999999999"}
    assert canonically(spark, numbers) == list(numbers.values())
    assert canonically(spark, [f'{{"a":[{n}]}}' for n in numbers]) == [f'{{"a":[{v}]}}' for v in numbers.values()]


def test_canonical_keys_and_strings(spark):
    cases = {
        '{"\U0001f600":1,"\uffee":2,"b":{"z":1,"ab":2,"a":3},"a":[{"y":1,"x":2}]}': '{"a":[{"x":2,"y":1}],"b":{"a":3,"ab":2,"z":1},"\uffee":2,"\U0001f600":1}',
        ' { "q" : "1e2 \\u0041 \\" , {" } ': '{"q":"1e2 A \\" , {"}',
        '{"\\u0062":1,"a":2}': '{"a":2,"b":1}',
        '{"a":1,"a":2}': None, "{": None, "nul": None, "": None, "[]": "[]", "{}": "{}", '"x"': '"x"', "null": "null", '{"a!b":"#1"}': '{"a!b":"#1"}',
    }
    assert canonically(spark, cases) == list(cases.values())
    assert canonically(spark, [None, '{"k":"' + "\\n" * 200_000 + '"}']) == [None, '{"k":"' + "\\n" * 200_000 + '"}']
    text = json.dumps({f"k{i}": [i, {"v": str(i)}] for i in range(3000)})
    assert canonically(spark, [text]) == [json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))]


def test_long_chains_and_joins(spark):
    """A chain of 300 calls each of which waits for the next, joins, circles and what hangs on them."""
    call = lambda c, i, t, on: (c, i, t, "add", '{"a":1,"b":1}', on)
    calls = [call(1, f"c{i}", i, [f"c{i + 1}"]) for i in range(300)]
    calls += [call(2, "a", 1, ["b", "c"]), call(2, "b", 2, ["d"]), call(2, "c", 3, ["e"]), call(2, "d", 4, ["e"]), call(2, "e", 5, []), call(2, "f", 6, ["a", "b", "b"]), call(2, "g", 7, ["f"])]
    calls += [call(3, "a", 1, ["b"]), call(3, "b", 2, ["c"]), call(3, "c", 3, ["a"]), call(3, "d", 4, ["c"]), call(3, "e", 5, ["d", "z"]), call(3, "f", 6, ["e", "g"]), call(3, "g", 7, [])]
    got = {k: r.level for k, r in rows(spark, calls, []).items()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {f"c{i}": 299 - i for i in range(300)}
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {"e": 0, "d": 1, "c": 1, "b": 2, "a": 3, "f": 4, "g": 5}
    assert {k[1]: v for k, v in got.items() if k[0] == 3} == {"a": None, "b": None, "c": None, "d": None, "e": None, "f": None, "g": 0}


def test_what_the_query_makes_up(spark, sf):
    out = chat.linked_calls(*chat.faulty_calls(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/conversations.parquet")), chat.REPLY)
    rows_ = out.select("status", "level", "problems").collect()
    assert {r.status for r in rows_} >= {"linked", "unanswered", "invalid"} and max(r.level for r in rows_) > 1
    assert {p for r in rows_ for p in r.problems} == {"type:turn", "missing:text", "extra:more"}


def test_results_without_a_call(spark):
    turns = [(1, 0, "assistant", "hello"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (1, 3, "assistant", "d"), (2, 0, "system", "s"), (None, 4, "assistant", "n")]
    docs = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in chat.linked_calls(*chat.as_calls(docs), chat.REPLY).collect()}
    assert {k: (r.turn, r.level, r.status, r.problems, r.n_results) for k, r in got.items()} == {
        (1, "t-1"): (0, 0, "orphan", [], 1),
        (1, "t1"): (1, 0, "linked", [], 1),
        (1, "t2"): (3, 0, "orphan", [], 2),
    }
    assert got[1, "t2"].json == '{"call":null,"result":"c","status":"orphan"}'
