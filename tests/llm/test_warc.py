import pytest

from rubrica.llm import warc
from rubrica.session import shared_dir
from tests.llm.conftest import rows

PAGES = "page_id bigint, url string, html string, payload string, original int"


@pytest.fixture
def pages(llm):
    return lambda data: llm.createDataFrame([(i, u, h, "clash", 7) for i, u, h in data], PAGES)


DATA = [
    (1, "http://a/ü x\r\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "", ""), (5, "http://c", "y" * 200000),
    (6, "http://d", "WARC/1.1\r\n\r\nContent-Length: 3"), (9, "http://a", "<p>é</p>"), (9, "http://a", "<p>é</p>"), (None, "http://n", "n"),
]


def test_round_trip(pages):
    got = {(r[0], r[3], r[4]): r[1] for r in rows(warc.archive_digest(pages(DATA)))}
    assert len(rows(warc.archive_digest(pages(DATA)))) == len(DATA)
    size = {(9, "response", None): 9, (1, "revisit", 9): 9, (2, "revisit", 9): 9, (3, "revisit", 4): 0, (4, "response", None): 0}
    assert {k: got[k] for k in size} == size
    assert (None, "response", None) in got
    assert all(r[5] is None for r in rows(warc.archive_digest(pages(DATA))))
    digests = {r[0]: r[2] for r in rows(warc.archive_digest(pages(DATA)))}
    assert digests[3] == warc.digest(b"") and digests[5] == warc.digest(b"y" * 200000)


def test_least_size_keeps_small_payloads_apart(pages):
    kinds = {r[0]: r[3] for r in rows(warc.linked(pages(DATA), least=1))}
    assert kinds[3] is None and kinds[1] == 9


def test_empty_table(pages):
    assert rows(warc.archive_digest(pages(DATA).limit(0))) == []


def test_payloads_come_back(llm, pages):
    folder = "file://" + shared_dir(llm, "warc").removeprefix("file://")
    made = rows(warc.write_archives(pages(DATA), folder))
    assert sum(m[1] for m in made) == len(DATA)
    back = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(llm, folder).collect() if r["record_type"] == "response"}
    assert back[9] == "<p>é</p>".encode() and back[6] == b"WARC/1.1\r\n\r\nContent-Length: 3"


def archive(records, samples=()):
    a = warc.Archive(list(samples), 3, 4096)
    return a.head() + b"".join(a.compress(r) for r in records)


def test_damage_is_reported():
    good = warc.record(1, "http://a", b"abc", warc.digest(b"abc"), None)
    assert [r[7] for r in warc.decode(archive([good, good]))] == [None, None]
    for bad, says in (
        (good.replace(b"WARC/1.1", b"WARC/9.9"), "version"), (good.replace(b"abc\r\n", b"abX\r\n"), "digest"), (good[:-1], "length"),
        (good.replace(b"WARC-Date", b"X-Date"), "missing"), (good.replace(b"Length: 3", b"Length: 4"), "payload length"),
    ):
        found = list(warc.decode(archive([bad, good])))
        assert says in found[0][7] and found[1][7] is None
    whole = archive([good, good])
    cut = list(warc.decode(whole[:-5]))
    assert cut[0][7] is None and "frame" in cut[1][7]


def test_dictionary_is_used():
    samples = [warc.record(i, f"http://host/{i}", b"<html><body>%d common text of pages</body></html>" % i, "X", None) for i in range(300)]
    a = warc.Archive(samples, 3, 2048)
    assert a.dictionary is not None
    found = list(warc.decode(a.head() + b"".join(map(a.compress, samples[:5]))))
    assert [f[0] for f in found] == [0, 1, 2, 3, 4]


def test_many_records_in_a_partition(llm, pages):
    data = [(i, f"http://a/{i}", f"<p>page {i % 700}</p>") for i in range(1000)]
    folder = "file://" + shared_dir(llm, "warc").removeprefix("file://")
    made = rows(warc.write_archives(pages(data).coalesce(1), folder))
    assert sum(m[1] for m in made) == 1000
    assert sorted(r["page_id"] for r in warc.read_archives(llm, folder).collect()) == list(range(1000))


def test_archives_are_cut(llm, pages):
    data = [(i, "http://a", f"<p>{i}</p>") for i in range(500)]
    folder = "file://" + shared_dir(llm, "warc").removeprefix("file://")
    made = rows(warc.write_archives(pages(data).coalesce(1), folder, dict_records=30, archive_bytes=4000))
    assert len(made) > 3 and sum(m[1] for m in made) == 500 and len({m[0] for m in made}) == len(made)
    back = warc.read_archives(llm, folder).collect()
    assert sorted(r["page_id"] for r in back) == list(range(500)) and not any(r["error"] for r in back)
