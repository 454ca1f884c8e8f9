import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from glossaudit.fixed_values import REPORT_COLUMNS, SITEMAP_NAMESPACE
from glossaudit.operators import findings, report, slicing
from glossaudit.params import AuditParams
from glossaudit.plans import audit as audits
from glossaudit.plans import batches
from glossaudit.sources import pages as page_source
from glossaudit.sources import sitemaps
from glossaudit.streaming import incremental

EN = "this is a long paragraph of english text that should be easy to recognise"
DE = "dies ist ein langer absatz mit deutschem text der leicht zu erkennen sein sollte"


def urlset(*locs):
    return f'<urlset xmlns="{SITEMAP_NAMESPACE}">' + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"


def index(*locs):
    return (f'<?xml version="1.0"?><sitemapindex xmlns="{SITEMAP_NAMESPACE}">'
            + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>")


def parsed(spark, documents, **how):
    df = spark.createDataFrame(list(documents.items()), "sitemap_url string, xml string")
    return sitemaps.parse_sitemaps(df, **how)


def urls(spark, documents, root, **how):
    return [(r.ord, r.url) for r in sitemaps.url_list(parsed(spark, documents), root, **how).orderBy("ord").collect()]


def test_locations(spark):
    ns, other = SITEMAP_NAMESPACE, "http://example.org/other"
    documents = {
        "plain": urlset(" http://a?x=1&amp;y=&#50; ", " ", "", "b", "b"),
        "prefixed": f'<s:urlset xmlns:s="{ns}" xmlns:i="{other}"><s:url><s:loc>a</s:loc><i:loc>no</i:loc>'
                    "<loc>no</loc></s:url></s:urlset>",
        "none": "<urlset><url><loc>no</loc></url></urlset>",
        "image": f'<urlset xmlns="{ns}" xmlns:image="{other}"><url><image:image><image:loc>no</image:loc></image:image>'
                 '<!-- <loc>no</loc> --><loc><![CDATA[c?x&y]]></loc></url></urlset>',
        "foreign": f'<urlset xmlns="{ns}"><url><loc>a</loc><image xmlns="{other}"><loc>no</loc></image></url>'
                   "<deep><er><loc>b</loc></er></deep></urlset>",
        "empty": f'<urlset xmlns="{ns}"/>',
        "index": index("x"),
    }
    rows = {r.sitemap_url: (r.kind, r.locs) for r in parsed(spark, documents).collect()}
    assert rows == {
        "plain": ("urlset", ["http://a?x=1&y=2", "b", "b"]), "prefixed": ("urlset", ["a"]), "none": ("urlset", []),
        "image": ("urlset", ["c?x&y"]), "foreign": ("urlset", ["a", "b"]), "empty": ("urlset", []),
        "index": ("sitemapindex", ["x"])}


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(urlset("x", "y"))
    documents = sitemaps.parse_sitemaps(sitemaps.read_sitemap_files(spark, str(tmp_path)))
    entries = sitemaps.sitemap_entries(documents).collect()
    assert [(r.kind, r.ord, r.loc) for r in entries] == [("urlset", 0, "x"), ("urlset", 1, "y")]
    assert sitemaps.url_count(documents, entries[0].sitemap_url).first().n_urls == 2


def test_nesting(spark):
    documents = {"root": index("two", "one"), "one": urlset("a", "b"), "two": index("three", "one"),
                 "three": urlset("c", "a"), "unused": urlset("z")}
    assert urls(spark, documents, "root") == list(enumerate(["c", "a", "a", "b", "a", "b"]))
    assert urls(spark, documents, "one") == [(0, "a"), (1, "b")]


def test_depth_limit_cycles_and_missing(spark):
    chain = {f"i{k}": index(f"i{k + 1}") for k in range(5)} | {"i5": urlset("a")}
    assert urls(spark, chain, "i0") == [(0, "a")]
    with pytest.raises(sitemaps.SitemapError):
        urls(spark, chain | {"i5": index("i6"), "i6": urlset("a")}, "i0")
    with pytest.raises(sitemaps.SitemapError):
        urls(spark, {"i0": index("i0")}, "i0")
    missing = {"i0": index("gone", "here", "empty"), "here": urlset("a"), "empty": urlset()}
    with pytest.raises(sitemaps.SitemapError):
        urls(spark, missing, "i0")
    assert urls(spark, missing, "i0", on_missing="skip") == [(0, "a")]


def test_malformed(spark):
    documents = {"good": urlset("a"), "bad": "<urlset><url>"}
    with pytest.raises(Exception):
        parsed(spark, documents).collect()
    assert [r.sitemap_url for r in parsed(spark, documents, on_malformed="skip").collect()] == ["good"]


@pytest.mark.parametrize("offset, limit, expected", [
    (0, 0, range(10)), (3, 0, range(3, 10)), (3, 4, range(3, 7)), (-5, 2, range(2)), (8, 100, range(8, 10)),
    (10, 5, []), (50, 0, []), (2, -1, range(2, 10)),
])
def test_slices(spark, offset, limit, expected):
    table = spark.range(10).withColumnRenamed("id", "ord")
    assert sorted(r.ord for r in slicing.url_slice(table, offset, limit).collect()) == list(expected)


@pytest.mark.parametrize("total, sizes", [(0, []), (1, [1]), (250, [250]), (251, [250, 1])])
def test_batches(spark, total, sizes):
    rows = slicing.url_batches(spark.range(total).withColumnRenamed("id", "ord")).orderBy("batch_id").collect()
    assert [r.n_urls for r in rows] == sizes and slicing.batch_count(total) == len(sizes)


def test_landed_bytes_are_read_whatever_they_are(spark, tmp_path):
    path = str(tmp_path / "bytes")
    rows = [(1, "u", bytearray(b"caf\xe9 \xff<p>x")), (2, "v", bytearray(b"")), (3, "w", None)]
    spark.createDataFrame(rows, "page_id long, url string, html binary").write.parquet(path)
    got = {r.page_id: r.html for r in page_source.read_pages(spark, path).collect()}
    assert got == {1: "caf\ufffd \ufffd<p>x", 2: "", 3: None}


def test_sitemap_files_by_encoding_and_address(spark, tmp_path):
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f'<sitemapindex {space}><sitemap><loc>https://m.org/a.xml</loc></sitemap><sitemap><loc>https://m.org/b.xml</loc></sitemap></sitemapindex>'
    leaf = '<?xml version="1.0" encoding="{}"?><urlset ' + space + "><url><loc>https://example.org/café{}</loc></url></urlset>"
    (tmp_path / "top.xml").write_text(index)
    (tmp_path / "a.xml").write_bytes(leaf.format("ISO-8859-1", "").encode("latin-1"))
    (tmp_path / "b.xml").write_bytes(leaf.format("windows-1252", "€").encode("cp1252"))
    want = ["https://example.org/café", "https://example.org/café€"]
    named = sitemaps.parse_sitemaps(sitemaps.read_sitemap_files(spark, str(tmp_path), "https://m.org"))
    assert [r.url for r in sitemaps.url_list(named, "https://m.org/top.xml").orderBy("ord").collect()] == want
    table = spark.createDataFrame([(f"{n}.xml", f"https://m.org/{n}.xml") for n in ("top", "a", "b")], "file string, sitemap_url string")
    named = sitemaps.parse_sitemaps(sitemaps.read_sitemap_files(spark, str(tmp_path), addresses=table))
    assert sitemaps.url_count(named, "https://m.org/top.xml").first().n_urls == 2
    with pytest.raises(sitemaps.SitemapError):
        sitemaps.url_list(named, "https://m.org/other.xml")
    (tmp_path / "b.xml").write_bytes(b"\xff\xfe" + leaf.format("UTF-16", "").encode("utf-16-le"))
    (tmp_path / "a.xml").write_bytes(b"\xef\xbb\xbf" + leaf.format("utf-8", "é").encode())
    got = {r.sitemap_url: r.xml for r in sitemaps.read_sitemap_files(spark, str(tmp_path), "https://m.org/").collect()}
    assert "café</loc>" in got["https://m.org/b.xml"] and got["https://m.org/a.xml"].startswith("<?xml") and "caféé" in got["https://m.org/a.xml"]


def test_spreading_a_joined_table_runs_no_job(spark, site):
    joined = site.join(site.select("page_id"), "page_id")
    spark.sparkContext.setJobGroup("composing", "nothing should run")
    assert page_source.audit_input(joined).columns == site.columns
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("composing")) == []
    spark.sparkContext._jsc.clearJobGroup()


def test_positions_are_dense(spark):
    table = spark.range(1000).select((F.col("id") * 7919 % 1000 - 500).alias("key"))
    rows = slicing.with_position(table, "key").collect()
    assert sorted((r.ord, r.key) for r in rows) == [(i, i - 500) for i in range(1000)]
    assert slicing.with_position(table.where("false"), "key").count() == 0


def test_page_source(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "u", bytearray("é".encode()))], "page_id long, url string, html binary").write.parquet(path)
    row = page_source.read_pages(spark, path).first()
    assert (row.status, row.html) == (200, "é")
    rows = [(1, "a", 200, "x"), (2, "b", 0, "x"), (3, "c", 200, ""), (4, "d", 404, "x"), (5, "e", None, "x"), (6, "f", 200, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, status int, html string")
    assert [r.page_id for r in page_source.usable_pages(pages).collect()] == [1, 4]
    assert [r.page_id for r in page_source.usable_pages(pages, strict=True).collect()] == [1]


@pytest.fixture(scope="module")
def site(make_pages):
    html = [f"<html lang={'fr' if i % 4 == 0 else 'en'}><body><p>{EN}</p><p>{EN} {i}</p><p>{DE if i % 3 == 0 else EN}</p></body></html>"
            for i in range(20)]
    return make_pages(*html)


def rows_of(df):
    columns = ["page_id", "seq", "issue_type", "detected_lang", "snippet"]
    return sorted(map(tuple, df.select(*columns).collect()))


def test_batched_audit_resumes(spark, site, model, tmp_path):
    output, params = str(tmp_path / "out"), AuditParams(batch_size=3)
    whole = rows_of(audits.audit(site, model))
    assert batches.batch_findings(spark, output).count() == 0
    assert batches.run_batches(site.where("page_id < 7"), model, output, params=params) == 3
    os.makedirs(f"{output}/findings/commit=99", exist_ok=True)
    # The list has grown: the batch that had one page is audited again, as a whole.
    assert batches.run_batches(site, model, output, params=params, batches_per_commit=2) == 5
    assert batches.run_batches(site, model, output, params=params) == 0
    assert rows_of(batches.batch_findings(spark, output)) == whole


def test_a_slice_does_not_complete_a_batch(spark, site, model, tmp_path):
    output, whole = str(tmp_path / "out"), rows_of(audits.audit(site, model))
    assert batches.run_batches(site, model, output, params=AuditParams(batch_size=6, limit=10)) == 2
    assert rows_of(batches.batch_findings(spark, output)) == [r for r in whole if r[0] < 10]
    assert batches.run_batches(site, model, output, params=AuditParams(batch_size=6, offset=8, limit=3)) == 1
    assert rows_of(batches.batch_findings(spark, output)) == [r for r in whole if r[0] < 11]
    assert batches.run_batches(site, model, output, params=AuditParams(batch_size=6)) == 3
    assert rows_of(batches.batch_findings(spark, output)) == whole
    assert batches.run_batches(site, model, output, params=AuditParams(batch_size=6, limit=7)) == 0


def test_a_rerun_that_finds_nothing_leaves_nothing(spark, site, model, tmp_path):
    output, folder = str(tmp_path / "out"), str(tmp_path / "reports")
    batches.run_batches(site, model, output, params=AuditParams(batch_size=5))
    assert batches.batch_findings(spark, output).count() > 0
    batches.write_batch_reports(spark, output, folder)
    assert sorted(n for n in os.listdir(folder) if n.startswith("batch")) == [f"batch_id={i}" for i in range(4)]
    changed = site.withColumn("url", F.concat("url", F.lit("?"))).withColumn("html", F.lit("<html></html>"))
    assert batches.run_batches(changed, model, output, params=AuditParams(batch_size=5)) == 4
    assert batches.batch_findings(spark, output).count() == 0


def test_what_changes_is_audited_again(spark, site, model, tmp_path):
    """HTML, a status, the ignored phrases, the model: just the batches that they concern become pending."""
    output, params = str(tmp_path / "out"), AuditParams(batch_size=5)

    def run(pages, model=model, phrases=None):
        done = batches.run_batches(pages, model, output, phrases, params)
        assert rows_of(batches.batch_findings(spark, output)) == rows_of(audits.audit(pages, model, phrases))
        return done

    assert run(site) == 4
    changed = site.withColumn("html", F.when(F.col("page_id").isin(3, 11), F.lit("<html></html>")).otherwise(F.col("html")))
    assert run(changed) == 2
    gone = changed.withColumn("status", F.when(F.col("page_id") == 19, 0).otherwise(F.col("status")))
    assert run(gone) == 1
    assert run(gone) == 0
    text = audits.text_blocks(audits.usable_pages(gone)).first().text
    phrases = spark.createDataFrame([(text.lower(),)], "phrase string")
    assert run(gone, phrases=phrases) == 4
    assert run(gone, phrases=phrases.union(phrases)) == 0
    assert run(gone) == 4
    other = replace(model, grams=model.grams.withColumn("lp", F.transform("lp", lambda x: x - 1)))
    assert run(gone, model=other) == 4


def test_batched_audit_ignores_findings_without_a_mark(spark, site, model, tmp_path):
    output, params = str(tmp_path / "out"), AuditParams(batch_size=5, offset=5, limit=10)
    part = site.where("page_id >= 5 AND page_id < 15")
    slicing.with_batch(audits.audit(part, model), 5, "page_id").write.parquet(f"{output}/findings/commit=5")
    assert batches.batch_findings(spark, output).count() == 0
    assert batches.run_batches(site, model, output, params=params) == 2
    assert rows_of(batches.batch_findings(spark, output)) == rows_of(audits.audit(part, model))


def test_audit_and_scan_honour_the_slice(spark, site, model):
    whole = rows_of(audits.audit(site, model))
    assert rows_of(audits.audit(site, model, params=AuditParams(offset=3, limit=9))) == [r for r in whole if 3 <= r[0] < 12]
    urls = [r.url for r in site.orderBy("page_id").collect()]
    wanted = [urls[5], urls[3], "https://example.org/not-landed", urls[3], urls[8]]
    listed = spark.createDataFrame(list(enumerate(wanted)), "ord long, url string")
    scanned, found = audits.scan(listed, site, model, params=AuditParams(offset=1, limit=3))
    assert sorted((r.page_id, r.url, r.status) for r in scanned.collect()) == [
        (1, urls[3], 200), (2, wanted[2], 0), (3, urls[3], 200)]
    of_third = [r[1:] for r in whole if r[0] == 3]
    assert rows_of(found) == [(i, *r) for i in (1, 3) for r in of_third]
    total = findings.scan_summary(scanned, found).first()
    assert (total.total_urls, total.flagged_urls) == (3, bool(of_third))


def test_incremental_audit_of_nothing(spark, tmp_path):
    assert incremental.incremental_findings(spark, str(tmp_path / "none")).count() == 0


def test_incremental_audit_equals_batch(spark, site, model, tmp_path):
    arriving, output, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    site.where("page_id < 11").repartition(3).write.parquet(arriving)

    def run():
        incremental.start_incremental_audit(
            spark, arriving, site.schema, output, progress, model, files_per_trigger=2).awaitTermination()

    run()
    assert rows_of(incremental.incremental_findings(spark, output)) == rows_of(audits.audit(site.where("page_id < 11"), model))
    site.where("page_id >= 11").repartition(2).write.mode("append").parquet(arriving)
    run()
    run()
    assert rows_of(incremental.incremental_findings(spark, output)) == rows_of(audits.audit(site, model))


def test_a_page_that_lands_again_replaces_its_findings(spark, site, model, tmp_path):
    arriving, output, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def land(pages, files):
        pages.repartition(files).write.mode("append").parquet(arriving)
        incremental.start_incremental_audit(
            spark, arriving, site.schema, output, progress, model, files_per_trigger=10).awaitTermination()
        return rows_of(incremental.incremental_findings(spark, output))

    whole = rows_of(audits.audit(site, model))
    assert land(site, 3) == whole
    assert land(site, 2) == whole
    clean = site.where("page_id IN (0, 3, 4)").withColumn("html", F.lit("<html></html>"))
    assert land(clean, 1) == [r for r in whole if r[0] not in (0, 3, 4)]
    assert land(site.where("page_id < 4"), 1) == [r for r in whole if r[0] != 4]


def test_of_files_that_arrive_together_the_last_one_counts(spark, site, model, tmp_path):
    arriving = str(tmp_path / "in")
    site.coalesce(1).write.parquet(arriving)
    for path in os.listdir(arriving):
        os.utime(f"{arriving}/{path}", (1_000_000, 1_000_000))
    later = site.where("page_id < 10").withColumn("html", F.lit("<html></html>"))
    later.coalesce(1).write.mode("append").parquet(arriving)
    incremental.start_incremental_audit(
        spark, arriving, site.schema, str(tmp_path / "out"), str(tmp_path / "progress"), model).awaitTermination()
    got = rows_of(incremental.incremental_findings(spark, str(tmp_path / "out")))
    assert got == [r for r in rows_of(audits.audit(site, model)) if r[0] >= 10] != []


def test_report_is_in_page_order(spark, site, model, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if it were large: several parts
    many = site.crossJoin(spark.range(30)).withColumn("page_id", F.col("page_id") * 30 + F.col("id")).drop("id").repartition(5)
    issues = audits.audit(many, model)
    issues = issues.repartition(7).cache()
    path = report.write_csv(report.placed_rows(issues, many, "map", "now"), str(tmp_path), "stamp")
    want = [(r.url, r.issue_type, r.snippet) for r in issues.orderBy("page_id", "seq").collect()]
    back = report.read_report(spark, path, lines=True).orderBy("line").collect()
    assert [r.line for r in back] == list(range(len(want)))
    assert [(r.url, r.issue_type, r.snippet) for r in back] == want
    assert len([n for n in os.listdir(path) if n.startswith("part")]) > 1
    feed = report.write_json(issues, str(tmp_path), "stamp")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = []
    for name in sorted(n for n in os.listdir(f"{feed}/issues") if n.startswith("part")):
        with open(f"{feed}/issues/{name}", encoding="utf-8") as part:
            lines += [json.loads(line) for line in part]
    assert [(r["url"], r["issue_type"], r["snippet"]) for r in lines] == want


def test_summary_counts_pages_as_they_are_read(spark, site, model):
    odd = site.withColumn("status", F.when(F.col("page_id") < 3, 0).otherwise(200))
    want = findings.scan_summary(odd, audits.audit(odd, model)).first()
    assert audits.audit_summary(odd, model).first() == want and want.total_urls == 20
    part = AuditParams(offset=2, limit=5)
    assert audits.audit_summary(odd, model, params=part).first().total_urls == 5


def test_report(spark, site, model, tmp_path):
    issues = audits.audit(site, model)
    rows = report.report_rows(issues, site, "=map", "2024-05-06T07:08:09")
    assert rows.columns == REPORT_COLUMNS
    first = rows.first()
    flagged = {i for i in range(20) if i % 4 == 0 or i % 3 == 0}
    assert (first.total_urls, first.flagged_urls) == (20, len(flagged))
    path = report.write_csv(rows, str(tmp_path), "stamp")
    back = report.read_report(spark, path)
    assert sorted(map(str, back.drop("sitemap_url").collect())) == sorted(map(str, rows.drop("sitemap_url").collect()))
    assert back.first().sitemap_url == "'=map"
    with pytest.raises(Exception):
        report.write_csv(rows, str(tmp_path), "stamp")
    assert report.search_report(back, "DEUTSCHEM").count() == 7
    ordered = report.search_report(back, sort_by="url", descending=True).collect()
    assert [r.url for r in ordered] == sorted((r.url for r in ordered), reverse=True)
    json_path = report.write_json(issues, str(tmp_path), "stamp", report.scan_scalars(issues, site, "=map", "then"))
    assert spark.read.json(json_path + "/issues").count() == issues.count()
    scan = spark.read.json(json_path + "/scan").first()
    assert (scan.sitemap_url, scan.total_urls, scan.flagged_urls, scan.scan_time) == ("=map", 20, len(flagged), "then")


def test_empty_report_has_a_header(spark, site, model, tmp_path):
    rows = report.report_rows(audits.audit(site, model).where("false"), site, "map", "now")
    path = report.write_csv(rows, str(tmp_path), "stamp")
    lines = [line.value for line in spark.read.text(path).collect()]
    assert lines == [",".join(REPORT_COLUMNS)]


def test_phrases_are_cleaned_after_their_lines_are_counted(spark):
    """A filter on the phrase itself went below the aggregation: every line of the table was stripped, not each distinct one."""
    lines = spark.createDataFrame([(x,) for x in ["  Same ", "same", " ", "", None, "Other\t"] * 5 + ["rare"]], "value string")
    often = lines.groupBy("value").agg(F.count("*").alias("n")).where("n >= 5").select("value")
    from glossaudit.sources import phrases

    found = phrases.phrases_from_lines(often)
    assert sorted(r.phrase for r in found.collect()) == ["other", "same"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Aggregate [value"):]
    assert "regexp_replace" in plan and "regexp_replace" not in below


def test_a_list_of_few_files_is_spread(spark, tmp_path):
    """Landed pages in one file: what is found of them was one task for parsing; now all cores have some."""
    rows = [(i, f"u{i}", 200, "<p>x</p>" * 50) for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, status int, html string").coalesce(1).write.parquet(str(tmp_path / "p"))
    landed = page_source.read_pages(spark, str(tmp_path / "p"))
    urls = spark.createDataFrame([(0, "u3"), (1, "u5"), (2, "u3"), (3, "gone")], "ord long, url string")
    found = page_source.scan_input(urls, landed)
    assert sorted((r.page_id, r.url, r.status, r.html is None) for r in found.collect()) == [
        (0, "u3", 200, False), (1, "u5", 200, False), (2, "u3", 200, False), (3, "gone", 0, True)]
    whole = landed.select(F.col("page_id").alias("ord"), "url")
    assert landed.rdd.getNumPartitions() == 1
    assert "RoundRobinPartitioning(4)" in page_source.scan_input(whole, landed)._jdf.queryExecution().executedPlan().toString()


def test_a_slice_reads_only_its_batches(spark, site):
    """The digests of all pages were made for every slice."""
    def ids(**slice_):
        return sorted(r.page_id for r in batches.page_digests(site, AuditParams(batch_size=6, **slice_)).collect())

    assert ids(limit=4) == list(range(6))
    assert ids(offset=7, limit=6) == list(range(6, 18))
    assert ids(offset=13) == list(range(12, 20))
    assert ids(offset=-3, limit=6) == list(range(6))
    assert ids() == list(range(20))


def test_batches_of_few_files_are_spread(spark, site, model, tmp_path, monkeypatch):
    """The join with the pending batches hid the size of the pages: one file was one task for parsing."""
    site.coalesce(1).write.parquet(str(tmp_path / "p"))
    landed, given = page_source.read_pages(spark, str(tmp_path / "p")), []
    monkeypatch.setattr(batches, "audit", lambda pages, *rest: given.append(pages) or audits.audit(pages, *rest))
    assert batches.run_batches(landed, model, str(tmp_path / "out"), params=AuditParams(batch_size=3)) == 7
    assert landed.rdd.getNumPartitions() == 1
    assert "RoundRobinPartitioning(4)" in given[0]._jdf.queryExecution().executedPlan().toString()
    assert rows_of(batches.batch_findings(spark, str(tmp_path / "out"))) == rows_of(audits.audit(site, model))
