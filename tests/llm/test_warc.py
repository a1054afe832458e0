import base64
import gzip
import hashlib
import json
from collections import defaultdict

import pytest

from querent.llm import warc

PAGES = "page_id long, url string, html string, fields string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def check(spark, pages):
    got = [tuple(r) for r in warc.archived_pages(spark.createDataFrame(pages, PAGES)).collect()]
    groups, want = defaultdict(list), []
    for page_id, _, html, _ in pages:
        groups[html or ""].append(page_id)
    for html, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i), reverse=True)
        want += [(i, len(html.encode()), sha(html), "revisit" if k else "response", ids[0] if k else None) for k, i in enumerate(ids)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_equal_payloads_revisit_the_largest(spark):
    check(spark, [(i, f"http://h/{i}", f"<p>{'ü' * (i % 7)}</p>", "clash") for i in range(60)])


def test_nulls_empties_repeats_and_long(spark):
    rows = [(1, None, None, None), (2, "u", "", None), (None, "u\r\nX: y", "a", "x"), (None, "u", "a", "x"), (7, "u", "a", "x"), (7, "u", "a", "x"), (7, "v", "a", "x"), (9, "w", "é漢" * 900_000, "")]
    check(spark, rows)
    check(spark, [(5, "u", "same", "")] * 9)
    check(spark, [(None, None, None, None)] * 3)
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_smaller_payloads_than_the_least_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xy", ""), (2, "b", "xy", ""), (3, "a", "xyz", ""), (4, "b", "xyz", "")], PAGES)
    rows = warc.deduplicated(pages, 3).collect()
    assert sorted((bytes(r.payload), r.record_type) for r in rows) == [(b"xy", "response"), (b"xy", "response"), (b"xyz", "response"), (b"xyz", "revisit")]
    revisit, kept = [next(r for r in rows if bytes(r.payload) == b"xyz" and r.record_type == k) for k in ("revisit", "response")]
    assert revisit.refers_to == kept.record_id and revisit.refers_to_uri == "b"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("warc") / "a")
    rows = [("response", f"http://h{i % 3}/{i}", bytearray(b"x" * i), {"X-N": str(i)}) for i in range(200)] + [("metadata", None, bytearray(b"k: v"), None)]
    warc.write(spark.createDataFrame(rows, "record_type string, target_uri string, payload binary, fields map<string,string>").repartition(3), at)
    return at


def test_filters_and_columns_reach_the_reader(spark, folder):
    rows = warc.read(spark, folder, "record_type string, target_uri string, payload_bytes long").where("record_type = 'response' and target_uri like 'http://h1/%'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan and "payload#" not in plan
    assert sorted(r.payload_bytes for r in rows.collect()) == [i for i in range(200) if i % 3 == 1]
    assert warc.read(spark, folder).where("record_type in ('metadata', 'none')").select("payload", "target_uri").collect() == [(b"k: v", None)]
    assert warc.read(spark, folder).where("payload_bytes > 197 and record_type = 'response'").count() == 2
    assert warc.read(spark, folder).where("target_uri is null").count() == 1


class Counting:
    """A file that counts what is read of it."""

    def __init__(self, data):
        import io

        self.data, self.io, self.read_bytes = data, io.BytesIO(data), 0

    def __getattr__(self, name):
        return getattr(self.io, name)

    def size(self):
        return len(self.data)

    def readinto(self, b):
        n = self.io.readinto(b)
        self.read_bytes += n
        return n


def test_unwanted_payloads_are_neither_read_nor_inflated(monkeypatch):
    big = bytes(hashlib.sha256(str(i).encode()).digest()[0] for i in range(1 << 20))
    one = [warc.record({"record_type": k, "payload": big, "target_uri": u}) for k, u in (("response", "a"), ("resource", "b"), ("resource", "a"))]
    for data in (b"".join(one), b"".join(map(warc.member, one))):
        file = Counting(data)
        rows = list(warc.rows_of(file, warc.Piece("p", 0, None), [("target_uri", "EqualTo", "b")], False, False))
        assert [r["target_uri"] for r in rows] == ["b"] and rows[0]["payload_bytes"] == len(big) and "payload" not in rows[0]
        assert file.read_bytes < len(data) / 2  # buffers of 256 kB at each of three records
        (row,) = warc.rows_of(Counting(data), warc.Piece("p", 0, None), [("target_uri", "EqualTo", "b")], True, False)
        assert row["payload"] == big


def test_archives_of_others(spark, tmp_path):
    """Plain files, and members without the subfield; folded header lines; no manifest."""
    one = [warc.record({"record_type": "resource", "payload": f"text {i}".encode() * 5000, "target_uri": f"u{i}"}) for i in range(5)]
    one.append(b"WARC/1.0\r\nwarc-type: warcinfo\r\nX-Long: a\r\n  b\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(b"".join(one))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, one)))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert len(rows) == 12 and {bytes(r.payload)[:6] for r in rows if r.record_type == "resource"} == {f"text {i}".encode() for i in range(5)}
    assert [r["fields"] for r in rows if r.record_type == "warcinfo"] == [{"X-Long": "a b"}] * 2
    assert warc.read(spark, str(tmp_path), "target_uri string").where("target_uri = 'u3'").count() == 2


def test_pieces_of_a_file_hold_all_records_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 2000)
    writer = warc.WarcWriter(str(tmp_path))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"record_type": ["response"] * 50, "target_uri": [f"u{i}" for i in range(50)], "payload": [b"p%d" % i for i in range(50)]})
    message = writer.write(iter([batch]))
    reader = warc.WarcReader({"path": str(tmp_path)}, warc.SCHEMA)
    (tmp_path / "part-lost.warc.gz").write_bytes(b"left by a lost task")
    writer.commit([message, None])
    pieces = reader.partitions()
    assert len(pieces) > 5
    got = [x for p in pieces for b in reader.read(p) for x in b.column("target_uri").to_pylist()]
    assert sorted(got) == sorted(f"u{i}" for i in range(50))
    writer.abort([message])
    assert not (tmp_path / message.name).exists()


def test_faults_are_errors(spark, tmp_path, folder):
    with pytest.raises(Exception, match="append-only"):
        warc.read(spark, folder).write.format("warc").mode("overwrite").save(folder)
    with pytest.raises(Exception, match="not columns"):
        warc.read(spark, folder, "nothing string").count()
    good = warc.record({"record_type": "response", "payload": b"abcdef"})
    for name, data in (("cut", good[:-6]), ("changed", good.replace(b"abcdef", b"abcdeg")), ("junk", b"hello" + good)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        with pytest.raises(Exception, match="a.warc at 0"):
            warc.read(spark, str(tmp_path / name), verify=True).count()
