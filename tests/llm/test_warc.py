import hashlib

from stratalith.llm import warc

URL = "http://h/"


def expected(rows):
    big = {}
    for i, html in rows:
        raw = (html or "").encode()
        if i is not None and len(raw) >= 1000:
            big[raw] = max(i, big.get(raw, i))
    out = []
    for i, html in rows:
        if i is None:
            continue
        raw = (html or "").encode()
        top = big.get(raw, i)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if i < top else "response", top if i < top else None))
    return sorted(out, key=str)


def run(spark, rows, tmp_path, **more):
    pages = spark.createDataFrame([(i, URL, html, "x") for i, html in rows], "page_id long, url string, html string, body string").repartition(2)
    out = warc.archive(pages, path=f"file://{tmp_path}/a", **more)
    return sorted(map(tuple, out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip_with_copies_nulls_and_hostile_payloads(spark, tmp_path):
    hostile = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz"
    rows = [(1, "é" * 3000), (2, "é" * 3000), (9, "é" * 3000), (3, None), (4, ""), (5, "short"), (6, "short"), (7, hostile), (8, "WARC/1.1\r\n"), (10, "tail WARC/1.1"), (11, "tail\r\n"), (12, "\r\n\r\n"), (None, "gone"), (13, hostile * 40), (14, hostile * 40), (9, "é" * 3000)]
    assert run(spark, rows, tmp_path, chunk=1 << 20) == expected(rows)


def test_small_chunks_stream_and_split_characters(spark, tmp_path):
    rows = [(i, "é€😀x" * n) for i, n in enumerate([0, 1, 5, 100, 400, 400, 2000])] + [(77, "y" * 1001), (77, "y" * 1001), (77, "z" * 1500)]
    assert run(spark, rows, tmp_path, chunk=7) == expected(rows)


def test_payloads_over_the_registered_chunk(spark, tmp_path):
    size = warc.CHUNK
    rows = [(i, "é" * (n // 2) + "x" * (n % 2)) for i, n in enumerate([size - 1, size, size + 1, 2 * size, 2 * size + 1, 70 * size, 70 * size])]
    assert run(spark, rows, tmp_path) == expected(rows)
    chunks = warc.read(spark, f"file://{tmp_path}/a")
    assert chunks.agg({"chunk": "max"}).first()[0] == 70 and chunks.selectExpr("max(octet_length(body)) AS n").first()["n"] == size


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_archive_is_well_formed(spark, tmp_path):
    run(spark, [(1, "x" * 10), (2, "y" * 30)], tmp_path, chunk=8)
    files = [p.read_bytes() for p in (tmp_path / "a").glob("part-*")]
    data = b"".join(files)
    kinds = []
    while data:
        assert data.startswith(b"WARC/1.1\r\n")
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        kinds.append(fields["WARC-Type"])
        data = rest[n + 4 :]
    assert sorted(kinds) == ["continuation"] * 4 + ["response"] * 2


def test_cuts_hold_every_byte():
    for text in (b"", b"WARC/1.1", b"xWARC/1.1\r\ny", b"WARC/1.1\r\n" * 5):
        for chunk in (3, 8, 100):
            at = warc.cuts(text, chunk)
            assert at[0] == 0 and at[-1] == len(text)
            assert all(b"WARC/1.1\r\n" not in text[a:b] + b"\r\n\r\n" for a, b in zip(at, at[1:], strict=False))
