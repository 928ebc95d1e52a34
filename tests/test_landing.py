import os

import pytest

from filigree.sources.url_source import LandedUrls, LandedUrlsReader, landed


def site(tmp_path, names):
    folder = tmp_path / "site"
    folder.mkdir(exist_ok=True)
    for name in names:
        (folder / name).write_bytes(f"body of {name}".encode())
    return folder


def urls(spark, folder, names):
    return spark.createDataFrame([((folder / n).as_uri(), f"2024/{n}") for n in names], "url string, local_path string")


def test_a_failure_half_way_fetches_only_the_rest(spark, tmp_path):
    names = [f"f{i:02}.htm" for i in range(8)]
    folder = site(tmp_path, names[:-1])  # the last one is missing
    out = tmp_path / "out"

    def run():
        return landed(urls(spark, folder, names), out.as_uri(), user_agent="t t@example.com", pause=0).collect()

    with pytest.raises(Exception, match="f07"):
        run()
    there = {p.name: p.stat().st_mtime_ns for p in (out / "2024").iterdir()}
    assert 0 < len(there) < 8 and not [n for n in there if n.startswith(".")]
    site(tmp_path, names)
    rows = {r.local_path: r for r in run()}
    assert len(rows) == 8 and {p for p, r in rows.items() if not r.fetched} == {f"2024/{n}" for n in there}
    assert {n: (out / "2024" / n).stat().st_mtime_ns for n in there} == there
    assert (out / "2024" / "f07.htm").read_text() == "body of f07.htm" and rows["2024/f07.htm"].bytes == 15
    assert not any(r.fetched for r in run())


def test_one_partition_for_each_lane_of_a_host(spark, tmp_path):
    manifest = tmp_path / "manifest"
    for host, lane in (("a.example", 0), ("a.example", 1), ("b.example", 0)):
        os.makedirs(manifest / f"host={host}" / f"lane={lane}")
        (manifest / f"host={host}" / f"lane={lane}" / "part-0.parquet").write_bytes(b"")
        (manifest / f"host={host}" / f"lane={lane}" / "_SUCCESS").write_bytes(b"")
    reader = LandedUrlsReader({"manifest": str(manifest), "landing": "x", "userAgent": "t"})
    assert [len(p.files) for p in reader.partitions()] == [1, 1, 1]
    assert LandedUrls.name() == "landed_urls"


def test_nothing_to_land_and_repeated_paths(spark, tmp_path):
    folder = site(tmp_path, ["a.htm"])
    assert landed(urls(spark, folder, []).limit(0), str(tmp_path / "o"), user_agent="t").collect() == []
    found = landed(urls(spark, folder, ["a.htm", "a.htm"]), str(tmp_path / "o"), user_agent="t", pause=0, lanes=3).collect()
    assert [(r.local_path, r.fetched) for r in found] == [("2024/a.htm", True)]
