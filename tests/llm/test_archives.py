"""Archives of odd pages: none, without ids, of several megabytes; files by bytes; foreign archives of many members."""

import glob
import gzip

from lodegrain.llm import warc

PAGES = "page_id long, url string, payload string"


def archived(spark, pages, path):
    resolved = warc.resolve_revisits(spark.createDataFrame(pages, PAGES))
    warc.write_archives(resolved, path)
    return sorted(map(tuple, warc.read_archives(spark, path).select("page_id", "record_type", "payload_bytes", "refers_to", "payload", "fault").collect()), key=str)


def test_no_pages(spark, tmp_path):
    assert archived(spark, [], str(tmp_path / "none")) == []


def test_null_ids_and_texts(spark, tmp_path):
    got = archived(spark, [(None, None, None), (None, "u", "x"), (4, "u\r\nv", "x"), (5, "u", ""), (6, "u", None)], str(tmp_path / "odd"))
    assert got == sorted([(None, "revisit", 0, 6, None, None), (5, "revisit", 0, 6, None, None), (6, "response", 0, None, "", None), (None, "revisit", 1, 4, None, None), (4, "response", 1, None, "x", None)], key=str)


def test_long_pages_are_in_files_of_few_records(spark, tmp_path):
    lengths = [10, 70_000, 80_000, 600_000, 5_000_000, 6_000_000, 33 << 20]
    pages = [(i, "u", f"{i:02d}é\n" + "y" * n) for i, n in enumerate(lengths)]
    path = str(tmp_path / "long")
    got = archived(spark, pages, path)
    assert [(x[0], x[1], x[4], x[5]) for x in sorted(got)] == [(i, "response", text, None) for i, _, text in pages]
    sizes = [[len(block) for _, block in warc.parse_stream(warc.inflate(open(f, "rb").read()))] for f in glob.glob(path + "/*.gz")]
    assert all(len(s) <= next(most for least, most in warc.FILE_RECORDS if least is None or size < least) for s in sizes for size in s)
    assert sum(map(len, sizes)) == len(pages)


def test_archive_of_many_members():
    parts = [f"WARC/1.1\r\nContent-Length: {len(t)}\r\n\r\n{t}\r\n\r\n".encode() for t in ("a" * i for i in range(300))]
    for step in (7, 1 << 20):
        data = b"".join(map(gzip.compress, parts))
        assert [len(block) for _, block in warc.parse_stream(warc.inflate(data, step))] == list(range(300))
