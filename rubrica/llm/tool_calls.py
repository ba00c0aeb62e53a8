"""Tool-call linking in DataFrame functions: join calls with results, order them topologically, validate, serialise.

* Calls meet results in an equi-join on (conversation, call id), which hashes or sorts as Spark sees fit and splits when one
  conversation is very long. No conversation is ever gathered in one row or window.
* Order: a call's key is the greatest (turn, hop) over all paths of references from it, where a path's end after `hop` steps
  is worth that call's turn; the call itself is (own turn, 0). So a key is above those of the calls it depends on, unless
  theirs are below its own turn anyway, and sorting by (order_turn, order_hop, turn, call_id) puts every call after what it
  depends on. Keys come from pointer doubling: each call points to one of its references, and a round replaces the pointer by
  its pointer's pointer, with the best key on the way. After as many rounds as the longest conversation's number of calls has
  bits, pointers have come to an end or go round a cycle; a key with more hops than the conversation has calls is that of a
  cycle. Calls with several references then take the best of them as their pointer, and doubling is repeated until none gets
  better. A call on a cycle, or behind one whose turns are above its own, has a null key and the status `cycle`.
* Arguments are parsed as variants and checked field by field against the tool's schema: known tool, an object, required
  fields, no unknown fields, types, allowed values. Canonical JSON has no white space and sorted keys at every level.

Null or malformed arguments are invalid, with the reason; null texts of results are JSON null. Rows that repeat a call id
within a conversation become one call, that of the smallest turn and arguments, with status `duplicate_id`; repeated results
likewise keep the first and add to `n_results`. Results without a call are returned with status `orphan_result`.
References to unknown ids are errors of the call and do not order it. Null conversations or ids never match and are ordered
by their turn alone. Texts of any length go whole into the message; they are parsed a row at a time. Empty tables give no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.llm.common import pick
from rubrica.session import cut_lineage

TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
SCHEMA = "tool string, field string, type string, required boolean, allowed array<string>"


def canonical(value: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it is not JSON."""
    return F.to_json(F.try_parse_json(value))


def quoted(text: Column) -> Column:
    """A text as a JSON string, null as JSON null."""
    wrapped = F.to_json(F.struct(text.alias("t")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """`calls` (tool, arguments, ...) plus `errors`, sorted texts that are empty when the arguments are right.

    `schemas` holds the tools' declarations, a row per field (SCHEMA); it is as small as the set of tools and is grouped by
    tool. A tool without fields has one row with a null field.
    """
    fields = schemas.groupBy(F.col("tool").alias("_tool")).agg(
        F.map_from_entries(
            F.filter(
                F.array_sort(F.collect_list(F.struct("field", F.struct("type", "required", "allowed").alias("rule")))),
                lambda e: e["field"].isNotNull(),
            )
        ).alias("_rules")
    )
    d = calls.join(fields, calls["tool"] == F.col("_tool"), "left")
    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    d = d.withColumn("_given", F.when(is_object, parsed.cast("map<string,variant>")))
    rules, given = F.col("_rules"), F.col("_given")
    names = F.map_keys(given)
    missing = F.transform(
        F.filter(F.map_entries(rules), lambda e: e["value"]["required"] & ~F.array_contains(names, e["key"])),
        lambda e: F.concat(F.lit("missing "), e["key"]),
    )
    unknown = F.transform(F.array_except(names, F.map_keys(rules)), lambda k: F.concat(F.lit("unknown "), k))

    def fits(e: Column) -> Column:
        kind = F.regexp_extract(F.schema_of_variant(e["value"]), "^[A-Z]+", 0)
        wanted = F.element_at(rules, e["key"])["type"]
        table = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        return F.array_contains(F.element_at(table, wanted), kind)

    known = F.filter(F.map_entries(given), lambda e: F.map_contains_key(rules, e["key"]))
    wrong = F.transform(F.filter(known, lambda e: ~F.coalesce(fits(e), F.lit(False))), lambda e: F.concat(F.lit("type of "), e["key"]))
    allowed = lambda e: F.element_at(rules, e["key"])["allowed"]
    outside = F.transform(
        F.filter(
            known,
            lambda e: allowed(e).isNotNull() & ~F.array_contains(allowed(e), F.coalesce(e["value"].cast("string"), F.lit(""))) & fits(e),
        ),
        lambda e: F.concat(F.lit("value of "), e["key"]),
    )
    errors = (
        F.when(F.col("_tool").isNull(), F.array(F.lit("unknown tool")))
        .when(F.col("arguments").isNull() | parsed.isNull(), F.array(F.lit("not JSON")))
        .when(given.isNull(), F.array(F.lit("not an object")))
        .otherwise(F.array_sort(F.concat(missing, unknown, wrong, outside)))
    )
    return d.withColumn("errors", errors).drop("_tool", "_rules", "_given")


def _doubled(points: DataFrame, rounds: int) -> DataFrame:
    """(conv_id, call_id, key): the best (turn, hop) over the path of pointers from each call, itself not counted; null if none.

    `points`: conv_id, call_id, to (a call id, null at an end), key (of the first step). Calls whose path has ended are done
    and only looked up.
    """
    at = cut_lineage(points.select("conv_id", "call_id", "to", "key", F.lit(1).cast("long").alias("length")))
    for _ in range(rounds):
        on = at.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("to").alias("_to"), F.col("key").alias("_key"), F.col("length").alias("_length"))
        going = at.filter("to IS NOT NULL").join(on, (F.col("conv_id") == F.col("_c")) & (F.col("to") == F.col("_i")), "left")
        beyond = F.when(F.col("_key").isNotNull(), F.struct(F.col("_key.turn").alias("turn"), (F.col("_key.hop") + F.col("length")).alias("hop")))
        going = going.select("conv_id", "call_id", F.col("_to").alias("to"), F.greatest("key", beyond).alias("key"), (F.col("length") + F.coalesce("_length", F.lit(0))).alias("length"))
        at = cut_lineage(at.filter("to IS NULL").unionByName(going))  # it is read three times in the next round
        if at.filter("to IS NOT NULL").isEmpty():
            break
    return at.select("conv_id", "call_id", "key")


ENDLESS = 1 << 40  # hops of a call whose path never ends; more than a conversation has calls


def ordered(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, order_turn, order_hop, unknown_refs, cycle) of calls with a unique (conv_id, call_id)."""
    nodes = calls.select("conv_id", "call_id", "turn")
    edges = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("depends_on")).alias("ref"))
    targets = nodes.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("turn").alias("ref_turn"))
    met = edges.join(targets, (edges["conv_id"] == F.col("_c")) & (edges["ref"] == F.col("_i")), "left")
    unknown = met.filter("_i IS NULL").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("ref")).alias("unknown_refs"))
    links = cut_lineage(met.filter("_i IS NOT NULL").select("conv_id", "call_id", "ref", "ref_turn"))
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    rounds = (2 * most).bit_length()  # paths of twice as many steps as there are calls
    several = not links.groupBy("conv_id", "call_id").count().filter("count > 1").isEmpty()
    pick_one = F.max(F.struct("ref_turn", "ref")).alias("best")
    chosen = links.groupBy("conv_id", "call_id").agg(pick_one)
    counts = nodes.groupBy(F.col("conv_id").alias("_n")).agg(F.count("*").alias("n"))

    own = F.struct("turn", F.lit(0).cast("long").alias("hop"))
    step = F.when(F.col("best").isNotNull(), F.struct(F.col("best.ref_turn").alias("turn"), F.lit(1).cast("long").alias("hop")))
    endless = lambda key: F.coalesce(F.col(f"{key}.hop") >= ENDLESS, F.lit(False))

    def keyed(chosen: DataFrame, old: DataFrame | None = None) -> DataFrame:
        """(conv_id, call_id, turn, best, key): keys from pointers; endless ones have ENDLESS hops.

        `old` has keys that a change of pointers made better. A call that is worse for it now goes round a cycle of changes,
        each of which was for the better: its key can be raised without end, by going round before leaving for its turn.
        Calls known to be endless are the end of a path.
        """
        points = nodes.join(chosen, ["conv_id", "call_id"], "left")
        if old is None:
            points = points.select("conv_id", "call_id", "turn", "best", F.col("best.ref").alias("to"), step.alias("key"))
        else:
            known = old.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("key").alias("_to"))
            points = points.join(known, (F.col("conv_id") == F.col("_c")) & (F.col("best.ref") == F.col("_i")), "left")
            points = points.select(
                "conv_id", "call_id", "turn", "best", F.when(~endless("_to"), F.col("best.ref")).alias("to"),
                F.when(endless("_to"), F.col("_to")).otherwise(step).alias("key"),
            )
        points = cut_lineage(points)
        found = _doubled(points.select("conv_id", "call_id", "to", "key"), rounds)
        both = points.drop("key", "to").join(found, ["conv_id", "call_id"], "left").withColumn("key", F.greatest(own, "key"))
        both = both.join(counts, F.col("conv_id") == F.col("_n"), "left")
        hop = F.when(F.col("key.hop") >= F.col("n"), ENDLESS).otherwise(F.col("key.hop"))
        new = both.select("conv_id", "call_id", "turn", "best", F.struct(F.col("key.turn").alias("turn"), hop.alias("hop")).alias("key"))
        if old is not None:
            new = new.join(old.select("conv_id", "call_id", F.col("key").alias("_old")), ["conv_id", "call_id"], "left")
            lost = F.coalesce(F.col("key") < F.col("_old"), F.lit(False))
            round_ = F.struct(F.col("_old.turn").alias("turn"), F.lit(ENDLESS).alias("hop"))
            new = new.withColumn("key", F.when(endless("_old"), F.col("_old")).when(lost, round_).otherwise(F.col("key"))).drop("_old")
        return cut_lineage(new)

    at = keyed(chosen)
    while several:
        up = F.struct(F.col("key.turn").alias("turn"), F.least(F.col("key.hop") + 1, F.lit(ENDLESS)).alias("hop"))
        to = at.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), up.alias("up"))
        offers = links.join(to, (links["conv_id"] == F.col("_c")) & (links["ref"] == F.col("_i")))
        offers = offers.groupBy("conv_id", "call_id").agg(F.max(F.struct("up", F.struct("ref_turn", "ref").alias("best"))).alias("o"))
        better = at.join(offers, ["conv_id", "call_id"]).filter(F.col("o.up") > F.col("key"))
        better = cut_lineage(better.select("conv_id", "call_id", F.col("o.best").alias("other")))
        if better.isEmpty():
            break
        moved = at.join(better, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("other", "best").alias("best"))
        at = keyed(moved, at)
    out = at.join(unknown, ["conv_id", "call_id"], "left").withColumn("cycle", F.col("key.hop") >= ENDLESS)
    place = lambda c: F.when(~F.col("cycle"), F.col(f"key.{c}"))
    return out.select(
        "conv_id", "call_id", place("turn").alias("order_turn"), place("hop").alias("order_hop"),
        F.coalesce("unknown_refs", F.array().cast("array<string>")).alias("unknown_refs"), "cycle",
    )


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without one.

    `calls`: conv_id, turn, call_id, tool, arguments (JSON text), depends_on (array of call ids, may be null);
    `results`: conv_id, turn, call_id, content. Returns conv_id, call_id, turn, order_turn, order_hop, n_results, status
    (ok, invalid, cycle, duplicate_id, missing_result, orphan_result — the first that holds, from the right), errors, message
    (canonical JSON).
    """
    c = pick(calls, conv_id="conv_id", turn="turn", call_id="call_id", tool="tool", arguments="arguments", depends_on="depends_on")
    c = c.withColumn("turn", F.col("turn").cast("long"))
    one = c.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "arguments", "tool", "depends_on")).alias("call"), F.count("*").alias("n_calls")
    )
    one = cut_lineage(one.select("conv_id", "call_id", "call.*", "n_calls"))
    r = pick(results, conv_id="conv_id", turn="turn", call_id="call_id", content="content")
    r = r.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"))
    r = r.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "result", "n_results")
    both = validated(one, schemas).join(r, (one["conv_id"] == F.col("_c")) & (one["call_id"] == F.col("_i")), "full")
    is_call = F.col("n_calls").isNotNull()
    both = both.select(
        F.when(is_call, F.col("conv_id")).otherwise(F.col("_c")).alias("conv_id"),
        F.when(is_call, F.col("call_id")).otherwise(F.col("_i")).alias("call_id"),
        F.coalesce("turn", F.col("result.turn")).cast("long").alias("turn"),
        "tool", "arguments", "errors", "result", "n_calls", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
    )
    o = ordered(one)
    o = o.select(*[F.col(x).alias(f"_{x}") for x in ("conv_id", "call_id")], "order_turn", "order_hop", "unknown_refs", "cycle")
    both = both.join(o, (both["conv_id"].eqNullSafe(F.col("_conv_id"))) & (both["call_id"].eqNullSafe(F.col("_call_id"))) & both["n_calls"].isNotNull(), "left")
    errors = F.concat(
        F.coalesce("errors", F.array().cast("array<string>")),
        F.transform(F.coalesce("unknown_refs", F.array().cast("array<string>")), lambda x: F.concat(F.lit("no call "), x)),
    )
    status = (
        F.when(F.col("n_calls").isNull(), "orphan_result")
        .when(F.col("n_results") == 0, "missing_result")
        .when(F.col("n_calls") > 1, "duplicate_id")
        .when(F.coalesce("cycle", F.lit(False)), "cycle")
        .when(F.size(errors) > 0, "invalid")
        .otherwise("ok")
    )
    message = F.concat(
        F.lit('{"arguments":'),
        F.coalesce(canonical(F.col("arguments")), quoted(F.col("arguments"))),
        F.lit(',"id":'),
        quoted(F.col("call_id")),
        F.lit(',"result":'),
        quoted(F.col("result.content")),
        F.lit(',"tool":'),
        quoted(F.col("tool")),
        F.lit("}"),
    )
    return both.select("conv_id", "call_id", "turn", "order_turn", "order_hop", "n_results", status.alias("status"), errors.alias("errors"), message.alias("message"))


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and tool schemas read off a chat table: a user's turn is a call, the assistant's turn after it its result.

    The tool follows from the turn's number; its arguments are the text and numbers of it. Some are wrong on purpose of the
    rule, as in real logs: the length of a text as a string, a field no schema knows, JSON without its last brace. A call
    depends on the user's turn two before it; every fifth refers to the one after it instead. Turns of other roles, the
    system's among them, are neither calls nor results and give no row; their number is that of the rows of those roles.
    """
    c = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    n = F.length(F.coalesce("text", F.lit("")))
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    tool = F.element_at(F.array(F.lit("search"), F.lit("calculate"), F.lit("translate")), (n % 3 + 1).cast("int"))
    plain = F.to_json(F.struct(F.col("text").alias("text"), (n % 10).alias("limit"), F.lit("en").alias("lang")))
    args = (
        F.when(n % 17 == 0, F.expr("left(to_json(struct(text AS text)), length(to_json(struct(text AS text))) - 1)"))
        .when(n % 13 == 0, F.to_json(F.struct((n % 10).cast("string").alias("limit"), F.col("text").alias("text"))))
        .when(n % 11 == 0, F.to_json(F.struct(n.alias("zoom"), F.col("text").alias("text"))))
        .otherwise(plain)
    )
    ref = F.when(n % 5 == 0, F.col("turn") + 2).when(F.col("turn") >= 4, F.col("turn") - 4)
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    calls = c.filter(user).select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), tool.alias("tool"), args.alias("arguments"),
        F.when(ref.isNotNull(), F.array(name(ref))).alias("depends_on"),
    )
    results = c.filter(reply).select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    fields = [
        (t, f, kind, must, allowed)
        for t, limit in (("search", "integer"), ("calculate", "number"), ("translate", "integer"))
        for f, kind, must, allowed in (("text", "string", True, None), ("limit", limit, t != "translate", None), ("lang", "string", False, ["de", "en"]))
    ]
    return calls, results, conversations.sparkSession.createDataFrame(fields, SCHEMA)


def chat_digest(conversations: DataFrame) -> DataFrame:
    return link(*chat_calls(conversations))
