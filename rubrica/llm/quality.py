"""Quality by weak supervision: rules vote good, bad or abstain; EM estimates their accuracies; a posterior decides.

`text_stats` measures every whole text in one pass (Arrow batches, one document at a time). Votes are column expressions.
Documents are counted by vote pattern — at most 3^rules rows, whatever the corpus — and expectation-maximisation runs on
those counts: each rule has a probability of each vote in good documents and in each kind of bad ones, and rules are
independent given that class. The posterior of a pattern is looked up per document in a broadcast of the same bounded size. No label is read.

Null and empty texts have no words, fail the base and are not kept. Repeated rows count and are judged each. An empty
table gives no rows. Columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rubrica.llm.common import WORDS, pick
from rubrica.session import cut_lineage

SYMBOLS = "#*$%&|<>"
SYMBOL = re.compile(f"[{SYMBOLS}]")
STATS = (
    "n_words n_distinct word_chars n_symbols n_lines n_dup_lines n_repeat_words n_upper_words n_marks n_end_lines n_letters n_symbol_words"
).split()


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words in windows of `width` that occur twice or more; ids number the distinct words of one text."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)
    # numbers of equal windows by repeated pairing: exact, as every step renumbers the distinct pairs
    code = ids[:n].astype(np.int64)
    top = int(ids.max()) + 1
    for k in range(1, width):
        code = code * top + windows[:, k]
        if k < width - 1:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The numbers of STATS for one whole text."""
    text = text or ""
    words = WORDS.findall(text)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    lines, known, dup, ends, n_lines = text.split("\n"), set(), 0, 0, 0
    for line in lines:
        if WORDS.search(line):
            n_lines += 1
            dup += line in known
            known.add(line)
            ends += line.rstrip().endswith((".", "!", "?", ":", '"', "…"))
    per_word = np.bincount(ids, minlength=len(seen)) if words else np.zeros(0, dtype=np.int64)
    upper = sum(int(n) for w, n in zip(seen, per_word, strict=True) if len(w) > 1 and w.isupper())
    letters = sum(int(n) for w, n in zip(seen, per_word, strict=True) if any(map(str.isalpha, w)))
    odd = sum(int(n) for w, n in zip(seen, per_word, strict=True) if SYMBOL.search(w))
    return (
        len(words),
        len(seen),
        sum(len(w) * int(n) for w, n in zip(seen, per_word, strict=True)),
        sum(map(text.count, SYMBOLS)),
        n_lines,
        dup,
        # without a word that comes twice there is no window that does
        repeated_words(ids) if len(seen) < len(words) else 0,
        upper,
        text.count("!") + text.count("?"),
        ends,
        letters,
        odd,
    )


def text_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS...) of a table with doc_id and text."""
    d = pick(docs, doc_id="doc_id", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t) for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATS)))], names=["doc_id", *STATS]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{s} bigint" for s in STATS))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstain. Shares of a document's words or lines, so that length alone decides nothing."""

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    length = _share("word_chars", "n_words")
    symbols, upper, marks = _share("n_symbols", "n_words"), _share("n_upper_words", "n_words"), _share("n_marks", "n_words")
    lines, repeats, ends = _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words"), _share("n_end_lines", "n_lines")
    fresh, letters = _share("n_distinct", "n_words"), _share("n_letters", "n_words")
    odd = _share("n_symbol_words", "n_words")
    enough = F.col("n_words") >= 30
    return {
        "word_length": vote((length >= 3) & (length <= 9), (length < 2) | (length > 14)),
        "symbols": vote(symbols < 0.02, symbols > 0.15),
        "symbol_words": vote(odd < 0.05, odd > 0.3),
        "upper_words": vote(upper < 0.05, upper > 0.3),
        "marks": vote(marks < 0.1, marks > 0.25),
        "repeated_lines": vote(lines < 0.05, (lines > 0.5) & (F.col("n_lines") >= 4)),
        "repeated_words": vote(repeats < 0.05, repeats > 0.2),
        "fresh_words": vote(enough & (fresh > 0.45), enough & (fresh < 0.2) & (F.col("n_words") < 3000)),
        "line_ends": vote(ends >= 0.5, (ends < 0.1) & (F.col("n_words") >= 20)),
        "letters": vote(letters >= 0.9, letters < 0.6),
    }


#: Kinds of bad documents and the rules that speak of each; EM starts from these and estimates the rest. The other rules
#: (word_length, line_ends) often err on good documents and speak of no kind alone.
KINDS = {
    "symbols": ("symbols", "symbol_words", "letters"),
    "shouting": ("upper_words", "marks"),
    "repetition": ("repeated_lines", "repeated_words", "fresh_words"),
}


def estimate(
    patterns: np.ndarray, counts: np.ndarray, names: list[str], rounds: int = 300, prior: float = 0.01
) -> tuple[np.ndarray, dict]:
    """Posterior probability of good per vote pattern, and the model: share of each class, vote probabilities by class.

    `patterns` holds votes in {-1, 0, 1}; who abstains says nothing of the class. Bad documents are bad in different ways, so the classes are good and the KINDS;
    a rule's accuracy is estimated in each. A single bad vote of a rule that often errs on good documents leaves a document
    good, one of a rule that rarely does makes it bad. The start says which class is which: a pattern is first taken for
    the kind whose rules vote bad most, or for good. A prior worth `prior` of the corpus leans the same way.
    """
    classes = ["good", *KINDS]
    if not len(patterns):
        return np.zeros(0), {"share": dict.fromkeys(classes, 0.0), "votes": np.zeros((0, len(classes), 2))}
    hot = np.stack([patterns == v for v in (-1, 1)], axis=2).astype(float)  # pattern, rule, vote
    member = np.array([[n in KINDS[k] for n in names] for k in KINDS])  # kind, rule
    blame = (patterns < 0).astype(float) @ (member / member.sum(axis=1, keepdims=True)).T
    post = np.full((len(patterns), len(classes)), 0.01)
    post[np.arange(len(patterns)), np.where(blame.max(axis=1) > 0, blame.argmax(axis=1) + 1, 0)] = 1
    post /= post.sum(axis=1, keepdims=True)
    lean = np.empty((len(names), len(classes), 2))
    lean[:, 0] = 0.01, 0.99
    for k in range(len(KINDS)):
        lean[:, k + 1] = np.where(member[k][:, None], (0.8, 0.2), (0.05, 0.95))
    weight = prior * counts.sum() + 1
    shares = np.array([0.9, *[0.1 / len(KINDS)] * len(KINDS)])
    share, votes = shares, lean
    for _ in range(rounds):
        old = post
        share = (counts @ post + weight * shares) / (counts.sum() + weight)
        votes = np.einsum("pc,prv->rcv", post * counts[:, None], hot) + (weight * shares)[None, :, None] * lean
        votes /= votes.sum(axis=2, keepdims=True)
        logs = np.einsum("prv,rcv->pc", hot, np.log(votes)) + np.log(share)
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        if np.abs(post - old).max() < 1e-10:
            break
    return post[:, 0], {"share": dict(zip(classes, share, strict=True)), "votes": votes}


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, STATS..., votes, base_failed, p_good, kept): every document with its posterior and the decision.

    The base fails with fewer than 10 words, or with more than a fifth of the words in repeated windows.
    """
    spark = docs.sparkSession
    votes = rules()
    stats = cut_lineage(text_stats(docs).withColumn("votes", F.array(*[v.cast("int") for v in votes.values()])))
    counted = stats.groupBy("votes").count().collect()  # at most 3^rules rows
    found = sorted((tuple(r["votes"]), r["count"]) for r in counted)
    p_good, _ = estimate(
        np.array([f[0] for f in found]).reshape(-1, len(votes)), np.array([f[1] for f in found], dtype=float), list(votes)
    )
    table = spark.createDataFrame(
        [(list(f[0]), float(p)) for f, p in zip(found, p_good, strict=True)], "votes array<int>, p_good double"
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        stats.join(F.broadcast(table), "votes")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
    )


def quality_digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose text is kept; each row is decided on its own, also where an id repeats."""
    row = F.struct("doc_id", F.md5("text").alias("mark"))
    bad = judge(docs.select(row.alias("doc_id"), "text")).filter(~F.col("kept")).select("doc_id.*").toDF("_bad", "_mark").distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_bad")) & F.md5(docs["text"]).eqNullSafe(F.col("_mark"))
    return docs.join(bad, same, "left_anti")
