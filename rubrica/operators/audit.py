"""Word-level difference between what was read and what was graded."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions.text import strip

# --- fixed values: punctuation that does not make two words different --------------------------------
_IGNORED = str.maketrans("", "", ".,;:!?()\"'")


def _adds_first(a: list[int], b: list[int]) -> list[int]:
    """A whole number per word of a, whose bit len(b) - 1 - j says that at (i, j) dropping b[j] keeps more common words.

    Rows of the table of common words are made from the end as bits, one where a row does not grow by b[j]; the carries of
    the addition are where it grows by a[i]. A row costs a few operations on numbers of len(b) bits.
    """
    at: dict[int, int] = {}
    for j, word in enumerate(reversed(b)):
        at[word] = at.get(word, 0) | 1 << j
    full = (1 << len(b)) - 1
    flat, rows = full, []
    for word in reversed(a):
        met = flat & at.get(word, 0)
        total = flat + met
        grown = (flat ^ met ^ total) >> 1
        flat = (total | (flat ^ met)) & full
        rows.append(flat & grown)
    rows.reverse()
    return rows


def diff_words(before: str, after: str) -> list[tuple[str, str]]:
    """Runs (op, text) with op same, removed or added; a tie between removing and adding removes first."""
    old, new = before.split(), after.split()
    numbers: dict[str, int] = {}
    a, b = ([numbers.setdefault(w.lower().translate(_IGNORED), len(numbers)) for w in words] for words in (old, new))
    bits, last = _adds_first(a, b), len(b) - 1
    ops, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            op = "same"
        else:
            op = "added" if bits[i] >> (last - j) & 1 else "removed"
        ops.append((op, old[i] if op == "removed" else new[j]))
        i, j = i + (op != "added"), j + (op != "removed")
    ops += [("removed", w) for w in old[i:]] + [("added", w) for w in new[j:]]
    return [(op, " ".join(w for _, w in run)) for op, run in groupby(ops, key=itemgetter(0))]


def edit_runs(blocks: DataFrame, key: str = "block_id") -> DataFrame:
    """Runs per block: key, run_no, op, text, words. `blocks`: key, raw_text, reconstructed_text; blank raw has none.

    Comparing n with m words takes n * m bits.
    """

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (k, n, op, text, text.count(" ") + 1)
                for k, raw, final in zip(pdf[key], pdf["raw_text"], pdf["reconstructed_text"], strict=True)
                for n, (op, text) in enumerate(diff_words(raw, final))
            ]
            yield pd.DataFrame(rows, columns=[key, "run_no", "op", "text", "words"])

    kind = dict(blocks.dtypes)[key]
    usable = blocks.where(strip(F.coalesce("raw_text", F.lit(""))) != "").select(key, "raw_text", "reconstructed_text")
    return usable.mapInPandas(diff, f"{key} {kind}, run_no int, op string, text string, words int")


def edit_audit(blocks: DataFrame, key: str = "block_id") -> DataFrame:
    """Removed and added runs and words per block."""
    runs = edit_runs(blocks, key)

    def total(op: str, what) -> Column:
        return F.coalesce(F.sum(F.when(F.col("op") == op, what)), F.lit(0))

    return runs.groupBy(key).agg(
        total("removed", F.lit(1)).alias("removed_runs"),
        total("added", F.lit(1)).alias("added_runs"),
        *[total(op, F.col("words")).alias(f"{op}_words") for op in ("same", "removed", "added")],
    )
