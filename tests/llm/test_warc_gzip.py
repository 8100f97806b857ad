import hashlib

import pytest

from emberlog.llm.warc_gzip import inflate, normalise, normalise_archives, read_index, read_members, record, records, round_trip, write_archives, write_monolith


def entry(k, payload, **more):
    return {"kind": "response", "record_id": f"urn:page:{k}", "target": "http://a/", "digest": hashlib.sha256(payload).hexdigest(), "payload": payload} | more


def test_normaliser_keeps_records_and_indexes_them(tmp_path):
    payloads = [b"", b"\r\n\r\n" * 5, b"x" * 700_000, "é…".encode() * 50]
    (path,) = write_monolith(f"file://{tmp_path}", iter([entry(k, p) for k, p in enumerate(payloads)]), 1 << 30)
    index, ends = normalise(path, f"file://{tmp_path}/members/a.warc.gz")
    assert not (tmp_path / path.removeprefix(f"file://{tmp_path}/")).exists() and normalise(path, f"file://{tmp_path}/members/a.warc.gz") == (index, ends)  # run again
    entries = read_index(index, 0, ends[-1])
    assert read_index(index, ends[0], ends[2] - ends[0]) == entries[1:3]
    assert len(ends) == 4 and [e["id"] for e in entries] == [f"urn:page:{k}" for k in range(4)]
    for k in (2, 0, 3, 1):  # each member alone
        ((headers, block),) = read_members(f"file://{tmp_path}/members/a.warc.gz", [entries[k]])
        assert block.partition(b"\r\n\r\n")[2] == payloads[k] and headers["warc-type"] == "response"
    with open(f"{tmp_path}/members/a.warc.gz", "rb") as f:
        assert b"".join(r for _, _, r in records(inflate(f.read))) == b"".join(record(**entry(k, p)) for k, p in enumerate(payloads))


def test_archives_roll_and_broken_ones_raise(tmp_path):
    paths = list(write_monolith(f"file://{tmp_path}", iter([entry(k, b"x" * 600) for k in range(5)]), 1000))
    assert len(paths) == 3
    with pytest.raises(ValueError):
        list(records(iter([record(**entry(1, b"abc"))[:-9]])))


def test_cut_streams_raise(tmp_path):
    (path,) = write_monolith(f"file://{tmp_path}", iter([entry(k, b"x" * 60_000) for k in range(20)]), 1 << 30)
    with open(path.removeprefix("file://"), "rb") as f:
        data = f.read()
    for left in (len(data) - 1, len(data) - 8, len(data) - 9, len(data) // 2, 5):
        with open(tmp_path / "cut.gz", "wb") as f:
            f.write(data[:left])
        with pytest.raises(ValueError):
            normalise(f"file://{tmp_path}/cut.gz", f"file://{tmp_path}/members/cut.warc.gz")
    with open(tmp_path / "two.gz", "wb") as f:
        f.write(data + data)
    assert len(normalise(f"file://{tmp_path}/two.gz", f"file://{tmp_path}/members/two.warc.gz")[1]) == 40


def test_record_names_are_unique_and_slices_are_whole(spark, tmp_path):
    rows = [(k // 3, "http://a/", ("x" * 200) if k % 3 < 2 else "y") for k in range(30)]
    files = write_archives(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}")
    slices = normalise_archives(spark, files, f"file://{tmp_path}", slice_rows=4).collect()
    entries = [e for s in slices for e in read_index(s.idx, s.start, s.size)]
    assert len(entries) == 30 == len({e["id"] for e in entries}) and max(len(read_index(s.idx, s.start, s.size)) for s in slices) <= 4
    names = {e["id"] for e in entries if e["type"] == "response"}
    refs = {h["warc-refers-to"].strip("<>") for s in slices for h, _ in read_members(s.archive, read_index(s.idx, s.start, s.size)) if h["warc-type"] == "revisit"}
    assert len(refs) == 1 and refs <= names


def expected(rows):
    groups: dict[bytes, list] = {}
    for page, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        for k, page in enumerate(ids):
            again = k > 0 and len(payload) >= 100
            out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    big = "é" * 60
    rows = [(1, big), (2, big), (None, big), (1, big), (3, None), (4, None), (5, ""), (6, "x" * 99), (7, "x" * 99), (8, "y" * 100), (9, "y" * 100), (10, "z" * 300_000)]
    pages = spark.createDataFrame([(p, None if p == 3 else "http://a/é?x ", h, "e") for p, h in rows], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in round_trip(spark, pages).collect()), key=str)
    assert got == expected(rows)


def test_empty_table(spark):
    assert round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
