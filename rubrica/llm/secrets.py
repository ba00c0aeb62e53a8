"""Secret scanning in built-in expressions: three patterns, and a sliding-window entropy test over other strings.

A candidate string is a run of 20 or more characters of letters, digits and `+/_=-`. Its class follows from the characters
it holds; strings of one kind of character (words, card numbers) have no class and are left alone. A window of `window`
characters slides over the candidate; the counts of its characters and the sum of n*log2(n) are updated by the one
character that leaves and the one that enters, so a string costs its length whatever the window. A candidate is a secret
when the highest entropy of its windows reaches its class's threshold and no allow-list pattern matches it whole.

Positions are code points, the end exclusive. Patterns are marked in the text with a private-use character and the text is
split there; a text's own use of that character is first replaced by another of the same length that no pattern matches.
Null and empty texts have no spans. Rows are independent: no shuffle, repeated rows give repeated results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.llm.common import pick

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LONG = ASSIGN.replace("]+)", "]{12,})")
# runs are maximal, so a least length in the pattern drops exactly the runs that are too short
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Class of a candidate, what it must hold, and the entropy in bits per character from which it is a secret.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("base62", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$", 3.6),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/_=-]+$", 3.9),
)
_WORDS = "(?:example|placeholder|changeme|xxxxxx|abcdef|012345)"
#: A delimited part of a candidate: letters or digits alone, too short for a candidate, or one that holds a placeholder.
_PART = rf"(?:[A-Za-z]{{0,19}}|[0-9]{{0,19}}|[A-Za-z0-9]*{_WORDS}[A-Za-z0-9]*)(?![A-Za-z0-9])"
#: Whole candidates that are no secrets: UUIDs, dates with a word, paths of words, placeholders among plain parts.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[A-Za-z_-]*[0-9]{4}-[0-9]{2}-[0-9]{2}[A-Za-z_-]*",
    r"/?[A-Za-z]+[0-9]{0,2}(?:/[A-Za-z]*[0-9]{0,4})+",
    rf"(?i:(?=.*{_WORDS})(?!.*(?<![A-Za-z0-9])(?!{_PART})).*)",
)
MARK, OTHER = chr(0xE000), chr(0xE001)
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _marked(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of a pattern, leftmost and not overlapping; `keep` tests the matched string."""
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    placed = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), (i % 2 == 1).alias("hit")))

    def step(acc, x):
        end = acc["at"] + F.length(x["p"])
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"))
        good = x["hit"] if keep is None else x["hit"] & keep(x["p"])
        return F.struct(
            end.alias("at"), F.when(good, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    return F.aggregate(placed, start, step, lambda acc: acc["found"])


def _none() -> Column:
    return F.array().cast(SPAN)


def window_entropy(string: Column, window: int) -> Column:
    """Highest Shannon entropy, in bits per character, of the windows of an ASCII string; null if it is shorter."""
    logs = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    codes = F.transform(F.regexp_extract_all(string, F.lit("(?s)."), F.lit(0)), F.ascii)

    def step(acc, x):
        new, old = x["new"], x["old"]
        # the leaving character first, then the entering one: two counts move, the rest of the sum stays
        gone = F.when(old.isNull(), 0.0).otherwise(
            logs[F.element_at(acc["counts"], old)] - logs[F.element_at(acc["counts"], old) - 1]
        )
        less = F.when(old.isNull(), acc["counts"]).otherwise(
            F.transform(acc["counts"], lambda n, i: F.when(i + 1 == old, n - 1).otherwise(n))
        )
        was = F.element_at(less, new)
        total = acc["total"] - gone + logs[was + 1] - logs[was]
        bits = F.lit(math.log2(window)) - total / F.lit(float(window))
        return F.struct(
            F.transform(less, lambda n, i: F.when(i + 1 == new, n + 1).otherwise(n)).alias("counts"),
            total.alias("total"),
            F.when(x["full"], F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"),
        )

    moves = F.transform(
        codes,
        lambda c, i: F.struct(
            c.alias("new"), F.when(i >= window, F.get(codes, i - window)).alias("old"), (i >= window - 1).alias("full")
        ),
    )
    start = F.struct(
        F.array_repeat(F.lit(0), 127).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1.0).alias("best")
    )
    best = F.aggregate(moves, start, step, lambda acc: acc["best"])
    return F.when(F.length(string) >= window, best)


def is_high_entropy(string: Column, window: int = 20, classes=CLASSES, allowed=ALLOWED) -> Column:
    """True when a candidate's class is known, it is not on the allow-list and a window reaches the class's threshold."""
    least = F.lit(None).cast("double")
    for _, pattern, bits in reversed(classes):
        least = F.when(string.rlike(pattern), F.lit(float(bits))).otherwise(least)
    listed = F.lit(False)
    for pattern in allowed:
        listed = listed | string.rlike(f"^(?:{pattern})$")
    # a difference of rounding errors must not decide
    high = window_entropy(string, window) + 1e-9 >= least
    return F.when(least.isNull(), False).when(listed, False).otherwise(high)


def scan_secrets(docs: DataFrame, text: str = "text", window: int = 20, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """`docs` plus `secret_spans`: spans (kind, start, end) by start, then kind in the order of KINDS.

    Entropy spans that the patterns' spans cover whole are left out, as that string is reported already. A column of that
    name in `docs` is replaced.
    """
    t = F.col(f"`{text}`")
    assign = F.when(
        t.rlike(ASSIGN_LONG), _marked(t, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12)
    ).otherwise(_none())
    access = F.when(t.rlike(ACCESS), _marked(t, ACCESS, "access")).otherwise(_none())
    hexes = F.when(t.rlike(HEX), _marked(t, HEX, "hex")).otherwise(_none())
    runs = F.when(
        t.rlike(RUN), _marked(t, RUN, "entropy", lambda m: is_high_entropy(m, window, classes, allowed))
    ).otherwise(_none())
    taken = [c for c in docs.columns if c.lower() != "secret_spans"]
    found = docs.select(
        *[F.col(f"`{c}`") for c in taken], F.struct(assign.alias("a"), access.alias("b"), hexes.alias("c"), runs.alias("d")).alias("secret_spans")
    )
    s = F.col("secret_spans")
    base = F.concat(s["a"], s["b"], s["c"])
    placed = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))

    def reached(r):
        """How far the patterns' spans cover a run from its start on without a gap."""
        return F.aggregate(placed, r["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))

    own = F.filter(s["d"], lambda r: reached(r) < r["end"])
    ordered = F.array_sort(
        F.transform(
            F.concat(base, own),
            lambda x: F.struct(
                x["start"].alias("start"),
                (F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]) - 1).alias("rank"),
                x["end"].alias("end"),
                x["kind"].alias("kind"),
            ),
        )
    )
    plain = F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.withColumn("secret_spans", F.when(F.size(base) + F.size(s["d"]) > 0, plain).otherwise(_none()))


def redacted(text: Column, spans: Column, cover: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by `cover`."""

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(cover))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of each document."""
    found = scan_secrets(pick(docs, doc_id="doc_id", text="text")).select("doc_id", "secret_spans")
    s = F.col("secret_spans")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of_kind(kind):
        return lambda x: x["kind"] == kind

    return found.select(
        "doc_id",
        *[F.size(F.filter(s, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.filter(s, lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        listed(s).alias("spans"),
    )
