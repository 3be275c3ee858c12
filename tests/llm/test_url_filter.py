"""Parts and rules held against plain loops, the model by what it must learn."""

from stakelens.llm.queries import QUERIES, URL_RULES
from stakelens.llm.url_filter import fit_urls, judge_urls, keep_allowed, score_url


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [r for r, _ in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit, key=len, default=None)


ODD = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "https://a.example.com/en/x?y=/z#q", "ftp://com", "http://com/", "x://net/es/1",
    "http://a.b.net/fr/\n2", "http://mynet/fr/", "http://ÄÖ.net/fr/é", "http://example.com?x=/en/", "a://b://c/d", "http://x.org/" + "p" * 20_000, "http://example.com/EN/a",
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(ODD + ODD[4:6])], "page_id long, url string, host string, note string")
    got = judge_urls(pages, URL_RULES).collect()
    verdicts = dict(URL_RULES)
    assert len(got) == len(ODD) + 2
    for r in got:
        assert (r.host, r.path, r.rule) == plain(r.url), r.url
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == verdicts[r.rule])
    assert keep_allowed(pages, URL_RULES).columns == pages.columns
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_url_logistic"](spark, sf)
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(pages) and all((r.host, r.path, r.rule) == plain(pages[r.page_id]) for r in rows)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_model_learns(spark):
    rows = [(f"shop{i}.casino-win.biz", f"/play/{i}", 0) for i in range(60)] + [(f"docs{i}.library.org", f"/read/{i}", 1) for i in range(60)]
    model = fit_urls(spark.createDataFrame(rows + [(None, "/", 1), ("a", "b", None)], "host string, path string, label int"))
    new = spark.createDataFrame([("new.casino-win.biz", "/play/x"), ("other.library.org", "/read/y")], "host string, path string")
    bad, good = [r.p for r in new.select("host", score_url(new.host, new.path, model).alias("p")).orderBy("host").collect()]
    assert bad < 0.1 < 0.9 < good


def test_labelled_urls_are_taken_apart_once(spark, monkeypatch):
    """The sample is kept, and the filter on the rule reads host and path as columns."""
    from stakelens.llm import url_filter as u

    kept, plain_checkpoint = [], u.checkpointed
    monkeypatch.setattr(u, "checkpointed", lambda df: kept.append(df) or plain_checkpoint(df))
    pages = spark.createDataFrame([(i, f"http://www.example.com/{'en' if i % 2 else 'de'}/{i}") for i in range(40)], "page_id long, url string")
    judged = judge_urls(pages, URL_RULES)
    assert len(kept) == 1 and kept[0].count() == 40
    assert kept[0]._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 2
    assert judged.count() == 40
