import re

from vitrine.llm import url_reputation as U

URLS = [None, "", "nothing", "http://", "HTTP://A.B.NET", "https://x.example.NET/en/1", "https://example.net/en",
        "http://notexample.net/en/", "ftp://net/p?x=1#y", "http://a.example.com/de/#f", "http://É.example.com/de/1",
        "http://org/fr/", "http://w.org/fr/?q", "http://w.org?x=/fr/", "a://b://c/d", "x://h.example.com/es/1\n2",
        "http://h.example.com/es/1", "http://h.example.com/es/1"]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for says, rule in U.RULES:
        at, tail = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, says))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, n int")
    got = {r["page_id"]: r for r in U.judge(pages).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, says = brute(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == says if says else got[i]["verdict"] in ("allow", "block")
    assert U.judge(pages.limit(0)).count() == 0


def test_reputation_shrinks(spark):
    rows, marks = [], []
    for i in range(60):
        for host, bad in (("good.a.com", 0), ("bad.b.com", 1), ("mixed.b.com", i % 2)):
            marks.append((host, bad))
    marks += [("once.a.com", 1), ("none.b.com", None), (None, 1)]
    for i, host in enumerate(["good.a.com", "bad.b.com", "mixed.b.com", "once.a.com", "new.a.com", "new.b.com", "x.org"]):
        rows.append((i, f"http://{host}/p"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame(marks, "host string, bad int")
    got = {r["host"]: r["verdict"] for r in U.judge(pages, outcomes, rules=()).collect()}
    assert got == {"good.a.com": "allow", "bad.b.com": "block", "mixed.b.com": "allow", "once.a.com": "allow",
                   "new.a.com": "allow", "new.b.com": "allow", "x.org": "allow"}
    table = {r["host"]: r for r in U.host_reputation(outcomes, pages.select(U.host_of(pages["url"]).alias("host"))).collect()}
    assert table["good.a.com"]["mean"] < table["once.a.com"]["mean"] < table["bad.b.com"]["mean"]
    assert table["new.b.com"]["mean"] > table["new.a.com"]["mean"]  # a new host takes its domain's record
    assert table["bad.b.com"]["sd"] < table["new.b.com"]["sd"]
