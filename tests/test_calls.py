"""Model calls: attempts, pacing, batching."""

import time

from rubrica.inference import calls
from workload import stand_ins as offline
from rubrica.operators.audit import diff_words
from rubrica.plans.index import index_questions
from rubrica.plans.transcribe import transcribe_pages



def test_repair_counts_attempts_and_keeps_neighbours(spark):
    def model():
        seen = {}

        def reply(prompt):
            name = prompt.split()[0]
            seen[name] = seen.get(name, 0) + 1
            if name == "raises":
                raise RuntimeError("503")
            return "{'a': 1}" if name == "python" else '{"a": 1}' if seen[name] > 1 else "nope"

        return reply

    df = spark.createDataFrame([("python",), ("later",), ("raises",)], "prompt string").coalesce(1)
    got = {r["prompt"]: (r["attempts"], r["error"]) for r in calls.call_with_repair(df, "prompt", model).collect()}
    assert got == {"python": (1, None), "later": (2, None), "raises": (1, "503")}


def test_embedding_calls_are_distinct_and_batched(spark):
    df = spark.createDataFrame([(f"t{i % 7}",) for i in range(50)], "text string")

    def model():
        def embed(texts):
            assert len(texts) <= 3 and len(set(texts)) == len(texts)
            return [[float(len(t))] for t in texts]

        return embed

    out = calls.call_embed(df, "text", model, size=3)
    assert out.count() == 50
    assert out.where("embedding IS NULL").count() == 0


def test_index_with_a_model_that_never_answers(spark):
    new = spark.createDataFrame([(1, "q", "One fact."), (2, "q", "Two facts. Here.")], "question_id int, question string, model_answer string")
    old = spark.createDataFrame([], "question_id int, model_answer_hash string")
    concepts, rejects = index_questions(new, old, lambda: lambda p: "sorry", None)
    assert concepts.count() == 0
    assert rejects.count() == 2
    concepts, rejects = index_questions(new, old, offline.drawing_model, None)
    assert concepts.count() == 4 and rejects.count() == 0


def test_word_diff():
    assert diff_words("a b c", "a c") == [("same", "a"), ("removed", "b"), ("same", "c")]
    assert diff_words("a c", "a b c") == [("same", "a"), ("added", "b"), ("same", "c")]
    assert diff_words("Hello, World", "hello world!") == [("same", "hello world!")]
    assert diff_words("x", "y") == [("removed", "x"), ("added", "y")]
    assert diff_words("", "new words") == [("added", "new words")]
    assert diff_words("a b a b", "b a") == [("removed", "a"), ("same", "b a"), ("removed", "b")]


def test_pages_are_asked_again_and_no_answered_page_twice(spark, tmp_path):
    schema = "sheet_id bigint, page_index bigint, page_w bigint, page_h bigint, content binary"
    pages = spark.createDataFrame([(i, 0, 100, 100, str(i).encode()) for i in range(40)], schema)
    asked = tmp_path / "asked"

    def model():
        reply = offline.late_model()

        def call(content, prompt):
            with open(asked, "a") as f:
                f.write(f"{content.decode()}\n")
            return reply(content, prompt)

        return call

    run = lambda: {r["sheet_id"]: (r["attempts"], r["error"] is None) for r in transcribe_pages(pages, model, str(tmp_path / "w")).collect()}
    got = run()
    assert got == {i: (1, False) if i % 10 == 0 else (min(3, 1 + i % 4), i % 4 < 3) for i in range(40)}
    calls_made = sorted(map(int, asked.read_text().split()))
    assert calls_made == sorted(i for i in range(40) for _ in range(got[i][0]))
    # a job that was cut off in its second attempt asks for that one's pages only
    assert run() == got and sorted(map(int, asked.read_text().split())) == calls_made
    for part in ("raw/attempt=2", "judged/attempt=2", "judged/attempt=3", "raw/attempt=3"):
        (tmp_path / "w" / part / "_SUCCESS").unlink()
    assert run() == got
    again = len(asked.read_text().split()) - len(calls_made)
    assert again == sum(a >= 2 for a, _ in got.values()) + sum(a >= 3 for a, _ in got.values())


def test_no_pages(spark, tmp_path):
    schema = "sheet_id bigint, page_index bigint, page_w bigint, page_h bigint, content binary"
    out = transcribe_pages(spark.createDataFrame([], schema), offline.late_model, str(tmp_path / "w"))
    assert out.columns == ["sheet_id", "page_index", "page_w", "page_h", "reply", "error", "attempts"] and out.count() == 0


def test_word_difference_of_long_texts_is_quick():
    words = [f"w{i * 7919 % 2003}" for i in range(12_000)]
    kept = [w for i, w in enumerate(words) if i % 7]
    begun = time.process_time()
    runs = diff_words(" ".join(words), " ".join(kept))
    assert time.process_time() - begun < 0.7
    assert " ".join(t for op, t in runs if op != "added") == " ".join(words)
    assert " ".join(t for op, t in runs if op != "removed") == " ".join(kept)
