import json
from datetime import UTC, date, datetime

import pytest

from filigree.functions.filing_paths import suffix
from filigree.operators.filings import extract_filings, select_filings
from filigree.operators.manifest import manifest_header, manifest_rows
from filigree.plans import download
from filigree.plans.download import download_filings
from filigree.sinks.files import write_manifest
from filigree.sources.parameters import Selection, tickers
from filigree.sources.submissions import page_blocks, read_pages
from pyspark.sql import functions as F

SELECTION = Selection(as_of=date(2026, 6, 1))
CIKS = {"T1": "0000000101", "T2": "0000000202", "T3": "0000000303"}


def block(form, accession, document, filed, reported):
    return {
        "form": form, "accessionNumber": accession, "primaryDocument": document,
        "filingDate": filed, "reportDate": reported,
    }


PAGES = {
    "CIK0000000101.json": {
        "filings": {
            "files": [{"name": "CIK0000000101-submissions-001.json"}],
            "recent": block(
                ["10-K/A", "10-K", "8-K", "10-K"],
                ["0000000101-25-000009", "0000000101-25-000008", "0000000101-25-000003", "0000000101-24-000007"],
                ["t1-25a.htm", "t1-25.htm", "t1-8k.htm", "t1-24.htm"],
                ["2025-12-01", "2025-11-01", "2025-05-01", "2024-11-01"],
                ["2025-09-30", "2025-09-30", "2025-04-30", ""],
            ),
        }
    },
    "CIK0000000101-submissions-001.json": block(
        ["10-K", "10-K", "10-K", "20-F", "20-F"],
        ["0000000101-23-000006", "0000000101-21-000002", "0000000101-21-000001", "0000000101-22-000005",
         "0000000101-22-000004"],
        ["t1-23", "t1-21.htm", "t1-20.htm", "t1-22a.htm", "t1-22b.txt"],
        ["2023-11-01", "2021-11-01", "2021-01-05", "2022-11-01", "2022-11-01"],
        ["2023-09-30", "2021-09-30", "2020-12-31", "2022-09-30", "2022-09-30"],
    ),
    "CIK0000000202.json": {
        "filings": {
            "recent": block(
                ["S-1", "F-1", "F-1", "424B4", "20-F"],
                ["0000000202-24-000003", "0000000202-24-000002", "0000000202-23-000001", "0000000202-24-000004",
                 "0000000202-19-000009"],
                ["s1.htm", "f1.htm", "f1old.htm", "424b4.htm", "old20f.htm"],
                ["2024-03-01", "2024-03-01", "2023-12-01", "2024-04-10", "2019-04-01"],
                ["", "", "", "", "2018-12-31"],
            )
        }
    },
    "CIK0000000303.json": {
        "filings": {
            "files": [],
            "recent": block(["8-K"], ["0000000303-25-000001"], ["x.htm"], ["2025-02-01"], ["2025-01-31"]),
        }
    },
}

EXPECTED = [
    ("T1", "0000000101-25-000008", "2025/t1_10-k_2025-11-01_0000000101-25-000008.htm"),
    ("T1", "0000000101-24-000007", "2024/t1_10-k_2024-11-01_0000000101-24-000007.htm"),
    ("T1", "0000000101-23-000006", "2023/t1_10-k_2023-11-01_0000000101-23-000006.html"),
    ("T1", "0000000101-22-000005", "2022/t1_20-f_2022-11-01_0000000101-22-000005.htm"),
    ("T1", "0000000101-22-000004", "2022/t1_20-f_2022-11-01_0000000101-22-000004.txt"),
    ("T2", "0000000202-24-000004", "2024/t2_424b4_2024-04-10_0000000202-24-000004.htm"),
    ("T2", "0000000202-24-000002", "2024/t2_f-1_2024-03-01_0000000202-24-000002.htm"),
    ("T2", "0000000202-24-000003", "2024/t2_s-1_2024-03-01_0000000202-24-000003.htm"),
]


def land(folder, pages):
    for name, body in pages.items():
        (folder / name).write_text(json.dumps(body, indent=1))
    return str(folder)


def filings(spark, folder, pages=PAGES):
    blocks = page_blocks(read_pages(spark, land(folder, pages)))
    named = tickers(spark, ("T1", "T2", "T3"), CIKS)
    return extract_filings(blocks.join(named, "cik"))


def test_hand_worked_selection(spark, tmp_path):
    chosen = select_filings(filings(spark, tmp_path), SELECTION)
    rows = manifest_rows(chosen, ["ticker_ord", "rank"]).orderBy("ticker_ord", "rank").collect()
    assert [(r["ticker"], r["accession_number"], r["local_path"]) for r in rows] == EXPECTED
    assert rows[0]["source_url"] == (
        "https://www.sec.gov/Archives/edgar/data/101/000000010125000008/t1-25.htm"
    )
    assert rows[0]["cik"] == "0000000101"


def test_manifest_has_one_layout(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    rows = manifest_rows(select_filings(filings(spark, pages), SELECTION), ["ticker_ord", "rank"])
    head = manifest_header(rows, SELECTION, datetime(2026, 6, 1, tzinfo=UTC)).collect()[0]
    assert head["downloaded_count"] == 8
    assert head["generated_at_utc"] == "2026-06-01T00:00:00+00:00"
    out = tmp_path / "manifest"
    write_manifest(rows, ["ticker_ord", "rank"], str(out), SELECTION)
    lines = [json.loads(x) for p in sorted((out / "filings").glob("part-*")) for x in p.read_text().splitlines()]
    assert [f["accession_number"] for f in lines] == [e[1] for e in EXPECTED]
    assert lines[2]["local_path"] == EXPECTED[2][2]
    (header,) = (out / "header").glob("part-*")
    assert json.loads(header.read_text())["downloaded_count"] == 8


def test_companies_that_share_a_cik(spark, tmp_path):
    """Each of two tickers of one page gets its five different filings, and the page is fetched once."""
    recent = {
        "form": ["10-K"] * 6,
        "accessionNumber": [f"0000000101-2{i}-000001" for i in range(6)],
        "primaryDocument": [f"d{i}.htm" for i in range(6)],
        "filingDate": [f"202{i}-11-01" for i in range(6)],
        "reportDate": [f"202{i}-09-30" for i in range(6)],
    }
    site = tmp_path / "site"
    site.mkdir()
    land(site, {"CIK0000000101.json": {"filings": {"recent": recent, "files": []}}})
    companies = tickers(spark, ["A1", "A2"], {"A1": "0000000101", "A2": "0000000101"})
    blocks = page_blocks(download.fetch_pages(companies, "agent", site.as_uri(), str(tmp_path / "landed")))
    found = select_filings(extract_filings(blocks.join(companies, "cik")), SELECTION).collect()
    assert [p.name for p in (tmp_path / "landed").rglob("*.json")] == ["CIK0000000101.json"]
    for ticker in ("A1", "A2"):
        mine = [r["accession_number"] for r in found if r["ticker"] == ticker]
        assert len(mine) == len(set(mine)) == 5


def test_unequal_columns_fail(spark, tmp_path):
    bad = json.loads(json.dumps(PAGES))
    bad["CIK0000000303.json"]["filings"]["recent"]["form"].append("10-K")
    with pytest.raises(Exception, match="differ in length"):
        filings(spark, tmp_path, bad).collect()


def test_page_without_recent_fails(spark, tmp_path):
    bad = {**PAGES, "CIK0000000303.json": {"filings": {"files": []}}}
    with pytest.raises(Exception, match="without recent"):
        filings(spark, tmp_path, bad).collect()


def test_listed_page_not_landed_fails(spark, tmp_path):
    bad = {k: v for k, v in PAGES.items() if "submissions" not in k}
    with pytest.raises(Exception, match="not landed"):
        filings(spark, tmp_path, bad).collect()


def test_ticker_without_cik_fails(spark):
    with pytest.raises(Exception, match="no CIK"):
        tickers(spark, ("T1", "T9"), CIKS).collect()


def test_duplicates_count_unless_deduped(spark, tmp_path):
    rows = filings(spark, tmp_path)
    twice = rows.unionByName(rows.withColumn("page_ord", F.col("page_ord") + 10))
    kept = select_filings(twice, SELECTION).where("ticker = 'T1'").collect()
    assert [r["accession_number"] for r in kept][:2] == ["0000000101-25-000008"] * 2
    unique = select_filings(twice, Selection(as_of=SELECTION.as_of, dedupe=True)).orderBy("ticker", "rank")
    assert [r["accession_number"] for r in unique.collect()] == [e[1] for e in EXPECTED]


def test_one_company_with_most_rows_is_cut_before_the_shuffle(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    filings(spark, pages).write.parquet(str(tmp_path / "filings"))
    table = spark.read.parquet(str(tmp_path / "filings"))
    plan = select_filings(table, SELECTION)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_suffix(spark):
    names = ["a.htm", "a.b.txt", ".foo", "", "noext", "d/x.html", "a.", "..b", "d.x/foo"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(suffix(F.col("n"))).collect()] == [
        ".htm", ".txt", "", "", "", ".html", "", ".b", "",
    ]


def test_year_window_excludes_the_current_year():
    assert SELECTION.years() == ["2021", "2022", "2023", "2024", "2025"]


def test_whole_run_from_a_file_site(spark, tmp_path):
    site = tmp_path / "site"
    site.mkdir()
    land(site, PAGES)
    for _, accession, path in EXPECTED:
        cik = int(accession[:10])
        names = {a: d for p in PAGES.values() for b in [p.get("filings", {}).get("recent", p)]
                 for a, d in zip(b["accessionNumber"], b["primaryDocument"])}
        folder = tmp_path / "archive" / str(cik) / accession.replace("-", "")
        folder.mkdir(parents=True)
        (folder / names[accession]).write_text(f"<p>{accession}")
    out = tmp_path / "out"
    (out / "2020").mkdir(parents=True)
    (out / "2020" / "old.htm").write_text("old")
    rows = download_filings(
        spark, out.as_uri(), "tests t@example.com", names=("T1", "T2", "T3"), ciks=CIKS, selection=SELECTION, pause=0,
        submissions_url=site.as_uri(), archive_url=(tmp_path / "archive").as_uri(),
    )
    assert rows.count() == 8
    assert {str(p.relative_to(out)) for p in out.glob("2*/*")} == {e[2] for e in EXPECTED}
    assert (out / EXPECTED[2][2]).read_text() == f"<p>{EXPECTED[2][1]}"
    text = "".join(p.read_text() for p in (out / "manifest" / "header").glob("part-*"))
    assert json.loads(text)["downloaded_count"] == 8
