import os
import random

import pytest

from lakeglass.sources import readers, sinks


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    rnd = random.Random(4)
    files = {"a.bin": os.urandom(40_000), "b/text": b"the same words " * 3000, "empty": b"", "z": bytes(rnd.randrange(256) for _ in range(9000)), "none": None}
    folder = str(tmp_path_factory.mktemp("archive") / "x")
    sinks.write_archive(spark.createDataFrame(list(files.items()), "name string, data binary"), "name", "data", folder, target=1024)
    return folder, files


def test_files_come_back(spark, archive):
    folder, files = archive
    got = {r["path"]: (bytes(r["content"]), r["intact"]) for r in readers.archive_extract(spark, folder).collect()}
    assert got == {p: (d or b"", True) for p, d in files.items()}
    assert [r["path"] for r in readers.archive_extract(spark, folder, "z").collect()] == ["z"]


def test_listing_chunks_and_totals(spark, archive):
    folder, files = archive
    listed = sorted(readers.archive_files(spark, folder).collect(), key=lambda r: r["chunk_start"])
    assert {r["path"]: r["size"] for r in listed} == {p: len(d or b"") for p, d in files.items()}
    spans = [(r["chunk_start"], r["chunk_end"]) for r in listed if r["size"]]
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    first = readers.archive_chunk(spark, folder, 0).first()
    owner = next(r["path"] for r in listed if r["size"] and r["chunk_start"] == 0)
    assert files[owner].startswith(bytes(first["content"])) and first["size"] == len(first["content"])
    s = readers.archive_stats(spark, folder).first()
    assert (s["files"], s["bytes"], s["chunks"]) == (5, sum(len(d or b"") for d in files.values()), spans[-1][1]) and 0 < s["stored"] < s["bytes"]
