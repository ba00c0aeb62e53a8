"""Stupid-backoff language-model scores of every document against all other documents.

The score of a word after its history is the longest n-gram's count over its context's count, times `alpha` for each step
back; the last step is the word's share of all words, and a word found nowhere else counts one half-step further with one
occurrence. Counts are those of the rest of the corpus: the document's own are taken off, so that a text does not predict
itself. Logarithms are summed as whole millionths, which makes sums exact and independent of order.

Counts are a table of hashed n-grams (64 bits) partitioned by hash. Documents are dealt to blocks by a hash; a block asks
each hash partition once for each n-gram it holds, with its number in the block, packed in arrays. The partition adds up the
blocks' numbers — this is the count table — and answers in the same order. The block joins the answers to the n-grams
exploded from its documents and sums per document. A frequent n-gram is one entry a block, so there are no hot keys, and
what is shuffled is texts once, distinct n-grams of blocks, and their counts.

Words are runs of characters other than ASCII white space, A-Z in lower case. Null texts and texts without words have 0 words
and score 0. Rows that repeat an id are separate documents. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rubrica.llm.common import pick
from rubrica.llm.shingles import ngrams, word_hashes

ALL_WORDS = np.uint64(0)  # the entry that counts words of any kind
BLOCK_DOCS, BLOCK_BYTES, BUCKET_BYTES = 4000, 16 << 20, 8 << 20


def _grams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words per text, and for each length the n-grams of all texts, one after the other."""
    words = [word_hashes(t) for t in texts]
    return np.array([len(w) for w in words], dtype=np.int64), [
        np.concatenate([ngrams(w, k) for w in words]) if words else np.zeros(0, np.uint64) for k in range(1, order + 1)
    ]


def _by_bucket(held: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in the order of bucket, then hash, and the ends of the buckets."""
    bucket = (held % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))


def _ask(table, order: int, buckets: int):
    """A block's n-grams and their numbers in it, a row per bucket."""
    block = table.column("block")[0].as_py()
    n, grams = _grams(table.column("text").to_pylist(), order)
    held, counts = np.unique(np.concatenate([*grams, np.full(1, ALL_WORDS)]), return_counts=True)
    counts[held == ALL_WORDS] = n.sum()
    at, ends = _by_bucket(held, buckets)
    parts = [at[begin:end] for begin, end in zip(np.append(0, ends[:-1]), ends, strict=True)]
    return pa.table(
        {
            "block": np.full(buckets, block),
            "bucket": np.arange(buckets),
            "grams": pa.array([held[p].tobytes() for p in parts], pa.binary()),
            "counts": pa.array([counts[p].astype("<i4").tobytes() for p in parts], pa.binary()),
        }
    )


def _count(table):
    """One bucket of the count table: sums over blocks, answered to each block in its own order."""
    asked = [np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, dtype="<i4") for c in table.column("counts").to_pylist()]).astype(np.int64)
    _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    sums = np.bincount(inverse, weights=counts).astype(np.int64)[inverse]
    ends = np.cumsum([len(a) for a in asked])
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "sums": pa.array([s.astype("<i8").tobytes() for s in np.split(sums, ends[:-1])], pa.binary()),
        }
    )


def millionths(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log(x) * 1e6).astype(np.int64)


def _score(docs, answers, order: int, buckets: int, alpha: float):
    """Scores of a block's documents from the answers to its n-grams."""
    n, grams = _grams(docs.column("text").to_pylist(), order)
    held = np.unique(np.concatenate([*grams, np.full(1, ALL_WORDS)]))
    at, _ = _by_bucket(held, buckets)
    totals = np.empty(len(held), dtype=np.int64)
    replies = dict(zip(answers.column("bucket").to_pylist(), answers.column("sums").to_pylist(), strict=True))
    totals[at] = np.concatenate([np.frombuffer(replies[b], dtype="<i8") for b in range(buckets)])
    doc = np.arange(len(n))
    rest = []  # by length: how often each n-gram occurs in other documents
    for k in range(1, order + 1):
        code = np.searchsorted(held, grams[k - 1])
        owner = np.repeat(doc, np.maximum(n - k + 1, 0))
        _, inverse, own = np.unique(owner * len(held) + code, return_inverse=True, return_counts=True)
        rest.append(totals[code] - own[inverse])
    everything = np.maximum(totals[np.searchsorted(held, ALL_WORDS)] - n, 1)
    owner = np.repeat(doc, n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # of a word in its document
    most = np.minimum(place + 1, order)
    seen = rest[0] > 0
    value = np.where(seen, rest[0], alpha) * alpha ** (most - 1.0) / everything[owner]
    length = np.where(seen, 1, 0)
    for k in range(2, order + 1):
        starts = np.cumsum(np.maximum(n - k + 1, 0)) - np.maximum(n - k + 1, 0)
        fits = np.flatnonzero(place >= k - 1)
        index = starts[owner[fits]] + place[fits] - k + 1
        inner = np.cumsum(np.maximum(n - k + 2, 0)) - np.maximum(n - k + 2, 0)
        context = inner[owner[fits]] + place[fits] - k + 1
        found = rest[k - 1][index] > 0
        w = fits[found]
        value[w] = alpha ** (most[w] - float(k)) * rest[k - 1][index[found]] / rest[k - 2][context[found]]
        length[w] = k
    logs = millionths(value)
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "n_words": n,
            "score_micro": np.bincount(owner, weights=logs, minlength=len(n)).astype(np.int64),
            "n_backed_off": np.bincount(owner, weights=length < most, minlength=len(n)).astype(np.int64),
        }
    )


def scored(docs: DataFrame, order: int = 2, alpha: float = 0.4) -> DataFrame:
    """(doc_id, n_words, score_micro, n_backed_off): the log score in millionths and the words found by a shorter n-gram."""
    d = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows, size = d.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    size = size or 0
    n_blocks = max(1, math.ceil(rows / BLOCK_DOCS), math.ceil(size / BLOCK_BYTES))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    dealt = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))

    def ask(table):
        return _ask(table, order, buckets)

    asked = dealt.groupBy("block").applyInArrow(ask, "block bigint, bucket bigint, grams binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_count, "block bigint, bucket bigint, sums binary")

    def score(left, right):
        return _score(left, right, order, buckets, alpha)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, "doc_id bigint, n_words bigint, score_micro bigint, n_backed_off bigint"
    )


#: The same scores for order 2 over exploded words.
SCORE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), t AS (
  SELECT row, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, unnest(list_prepend(NULL, w)[1:len(w)]) AS prior, len(w) AS n
  FROM d WHERE len(w) > 0
), one AS (SELECT word, count(*) AS c FROM t GROUP BY word),
two AS (SELECT prior, word, count(*) AS c FROM t WHERE prior IS NOT NULL GROUP BY prior, word),
own1 AS (SELECT row, word, count(*) AS c FROM t GROUP BY row, word),
own2 AS (SELECT row, prior, word, count(*) AS c FROM t WHERE prior IS NOT NULL GROUP BY row, prior, word),
total AS (SELECT count(*) AS c FROM t),
p AS (
  SELECT t.row, t.prior IS NOT NULL AS inner_word, two.c - own2.c AS c2, a.c - oa.c AS c_prior, b.c - ob.c AS c1,
         greatest(total.c - t.n, 1) AS others
  FROM t JOIN one b ON t.word = b.word JOIN own1 ob ON t.row = ob.row AND t.word = ob.word
  LEFT JOIN one a ON t.prior = a.word LEFT JOIN own1 oa ON t.row = oa.row AND t.prior = oa.word
  LEFT JOIN two ON t.prior = two.prior AND t.word = two.word
  LEFT JOIN own2 ON t.row = own2.row AND t.prior = own2.prior AND t.word = own2.word, total
), s AS (
  SELECT row,
         sum(round(ln(CASE WHEN c2 > 0 THEN c2 / c_prior::DOUBLE
                           ELSE (CASE WHEN c1 > 0 THEN c1::DOUBLE ELSE 0.4::DOUBLE END)
                                * (CASE WHEN inner_word THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END) / others END)
                   * 1000000::DOUBLE))::BIGINT AS score_micro,
         sum(CASE WHEN (inner_word AND coalesce(c2, 0) <= 0) OR (NOT inner_word AND c1 <= 0) THEN 1 ELSE 0 END)::BIGINT AS n_backed_off
  FROM p GROUP BY row
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(score_micro, 0)::BIGINT AS score_micro,
       coalesce(n_backed_off, 0)::BIGINT AS n_backed_off
FROM d LEFT JOIN s USING (row)
"""
