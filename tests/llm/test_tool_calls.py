import json
import random

import pytest

from rubrica.llm import tool_calls
from tests.llm.conftest import rows

CALLS = "conv_id bigint, turn bigint, call_id string, tool string, arguments string, depends_on array<string>, key string, comp int"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string, n_results int"
FIELDS = [
    ("search", "text", "string", True, None), ("search", "limit", "integer", False, None), ("search", "lang", "string", False, ["de", "en"]),
    ("sum", "values", "array", True, None), ("sum", "scale", "number", False, None), ("sum", "strict", "boolean", False, None),
    ("sum", "options", "object", False, None), ("ping", None, None, None, None),
]


@pytest.fixture
def link(llm):
    schemas = llm.createDataFrame(FIELDS, tool_calls.SCHEMA)

    def run(calls, results):
        c = llm.createDataFrame([(*c, "k", 1) for c in calls], CALLS)
        r = llm.createDataFrame([(*r, 3) for r in results], RESULTS)
        return tool_calls.link(c, r, schemas)

    return run


def by_id(df):
    return {(r["conv_id"], r["call_id"]): r for r in df.collect()}


def test_arguments(link):
    cases = {
        '{"text":"a","limit":3,"lang":"de"}': [], '{"limit":3}': ["missing text"], '{"text":1}': ["type of text"],
        '{"text":"a","zoom":1}': ["unknown zoom"], '{"text":"a","lang":"fr"}': ["value of lang"], '{"text":"a","limit":1.5}': ["type of limit"],
        '{"text":"a","limit":"3"}': ["type of limit"], "[1]": ["not an object"], '{"text":': ["not JSON"], None: ["not JSON"], "": ["not JSON"],
        '{"text":null}': ["type of text"], '{"lang":5,"zoom":[]}': ["missing text", "type of lang", "unknown zoom"],
    }
    got = by_id(link([(1, i, f"c{i}", "search", a, None) for i, a in enumerate(cases)], [(1, 50, f"c{i}", "r") for i in range(len(cases))]))
    for i, (text, errors) in enumerate(cases.items()):
        assert got[1, f"c{i}"]["errors"] == errors, text
        assert got[1, f"c{i}"]["status"] == ("invalid" if errors else "ok")
    more = by_id(link([(1, 0, "a", "sum", '{"values":[1],"scale":2,"strict":true,"options":{"x":{}}}', None), (1, 1, "b", "nope", "{}", None), (1, 2, "c", "ping", "{}", None), (1, 3, "d", "ping", '{"x":1}', None)], []))
    assert [more[1, x]["errors"] for x in "abcd"] == [[], ["unknown tool"], [], ["unknown x"]]


def test_canonical_messages(link):
    text = ' { "text" : "q\\u00e9 \\"x\\"\\n" , "lang": "de", "limit": 1 } '
    got = by_id(link([(1, 0, "c", "search", text, None), (1, 1, "d", "search", '{"b"', None)], [(1, 1, "c", 'line\n"two"'), (1, 1, "d", None)]))
    m = got[1, "c"]["message"]
    assert json.loads(m) == {"arguments": json.loads(text), "id": "c", "result": 'line\n"two"', "tool": "search"}
    assert m == json.dumps(json.loads(m), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, "d"]["message"]) == {"arguments": '{"b"', "id": "d", "result": None, "tool": "search"}


def test_linking(link):
    calls = [(1, 0, "a", "ping", "{}", None), (1, 1, "a", "ping", "{}", None), (1, 2, "b", "ping", "{}", None), (2, 0, "a", "ping", "{}", None), (None, 0, "n", "ping", "{}", None)]
    results = [(1, 3, "a", "x"), (1, 4, "a", "y"), (2, 1, "a", "z"), (2, 1, "q", "z"), (None, 1, "n", "z")]
    got = rows(link(calls, results).select("conv_id", "call_id", "status", "n_results", "turn"))
    assert sorted(got, key=str) == sorted(
        [(1, "a", "duplicate_id", 2, 0), (1, "b", "missing_result", 0, 2), (2, "a", "ok", 1, 0), (2, "q", "orphan_result", 1, 1),
         (None, "n", "missing_result", 0, 0), (None, "n", "orphan_result", 1, 1)], key=str,
    )
    assert rows(link([], [])) == []


def test_order_and_cycles(link):
    deps = {"a": ["c"], "b": ["a"], "c": ["d", "nowhere"], "d": [], "e": ["f"], "f": ["e"], "g": ["g"], "h": ["b", "d", "h2"], "h2": []}
    calls = [(1, i, k, "ping", "{}", v) for i, (k, v) in enumerate(deps.items())] + [(2, 0, "x", "ping", "{}", ["y"]), (2, 0, "y", "ping", "{}", None)]
    # a long chain of references forward
    calls += [(3, i, f"n{i}", "ping", "{}", [f"n{i + 1}"] if i < 4 else None) for i in range(5)]
    got = by_id(link(calls, [(c[0], 20, c[2], "r") for c in calls]))
    place = {k: (r["order_turn"], r["order_hop"], r["turn"], k[1]) for k, r in got.items()}
    for c, _, call, _, _, refs in calls:
        if (c, call) in {(1, "e"), (1, "f"), (1, "g")}:
            assert got[c, call]["status"] == "cycle" and got[c, call]["order_turn"] is None
            continue
        for ref in refs or []:
            assert ref == "nowhere" or place[c, ref] < place[c, call], (call, ref)
    assert got[1, "c"]["errors"] == ["no call nowhere"]
    assert [k[1] for k in sorted((k for k in place if k[0] == 3), key=lambda k: place[k])] == [f"n{i}" for i in range(4, -1, -1)]


def test_chats(llm):
    chats = llm.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = tool_calls.chat_digest(chats).toPandas()
    roles = chats.toPandas().role.value_counts()
    assert len(got[got.status != "orphan_result"]) == roles["user"] and set(got.status) >= {"ok", "invalid"}
    assert all(json.loads(m)["id"] for m in got.message)


def brute_keys(calls):
    """Greatest (turn, hop) over all walks, by as many relaxations as there are calls; None where it keeps rising."""
    turn = {(c, i): t for c, t, i, *_ in calls}
    refs = {(c, i): [(c, r) for r in (d or []) if (c, r) in turn] for c, _, i, _, _, d in calls}
    key = {v: (t, 0) for v, t in turn.items()}

    def relax():
        new = {v: max([key[v], *((key[u][0], key[u][1] + 1) for u in refs[v])]) for v in key}
        return new, {v for v in key if new[v] != key[v]}

    for _ in range(len(turn) + 1):
        key, _ = relax()
    rising = set()
    for _ in range(len(turn) + 1):
        key, more = relax()
        rising |= more
    return {v: None if v in rising else k for v, k in key.items()}


@pytest.mark.parametrize("seed", [1])
def test_order_at_random(link, seed):
    rng = random.Random(seed)
    calls = []
    for conv in range(40):
        n = rng.randint(1, 9)
        for i in range(n):
            refs = rng.sample(range(n + 1), min(n, rng.choice([0, 1, 1, 1, 2, 3]))) if rng.random() < 0.8 else [max(0, i - 1)] * (i > 0)
            calls.append((conv, rng.randint(0, n) if seed else i, f"c{i}", "ping", "{}", [f"c{r}" for r in refs] or None))
    want = brute_keys(calls)
    got = by_id(link(calls, []))
    assert {k: None if r["order_turn"] is None else (r["order_turn"], r["order_hop"]) for k, r in got.items()} == want
    assert None in want.values()


def test_long_conversations(link):
    """A chain of references forward, one backward and a cycle, each as long as the conversation."""
    n = 300
    calls = [(1, i, f"c{i}", "ping", "{}", [f"c{i + 1}"] if i < n - 1 else None) for i in range(n)]
    calls += [(2, i, f"c{i}", "ping", "{}", [f"c{i - 1}"] if i else None) for i in range(n)]
    calls += [(3, i, f"c{i}", "ping", "{}", [f"c{(i + 1) % n}"]) for i in range(n)]
    got = by_id(link(calls, []))
    assert all((got[1, f"c{i}"]["order_turn"], got[1, f"c{i}"]["order_hop"]) == (n - 1, n - 1 - i) for i in range(n))
    assert all((got[2, f"c{i}"]["order_turn"], got[2, f"c{i}"]["order_hop"]) == (i, 0) for i in range(n))
    assert all(got[3, f"c{i}"]["order_turn"] is None for i in range(n))


def test_long_text(llm):
    chats = llm.createDataFrame([(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", None), (1, 2, "system", "s"), (1, 3, None, "n"), (None, 0, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    got = by_id(tool_calls.chat_digest(chats))
    assert len(got) == 2 and len(got[1, "call_0"]["message"]) > 3_000_000
