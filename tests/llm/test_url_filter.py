import random
import re

from pyspark.sql import functions as F

from glossaudit.llm import url_filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://EXAMPLE.org/es/1", "https://a.example.org/en/1x?x=1#y", "http://org/", "http://borg/", "http://x.com/fr/", "x://y.com/de/3",
        "http://y.com", "http://y.com?u=http://z.org/", "http://É.org/a", "no url", "", None, "http:///p", "a://b://c.org/d", "http://h.net/" + "s/" * 3000,
        "http://a.example.org\n/es/2", "ftp://U.Com#/fr/"]


def test_parts_and_rules(spark):
    table = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3]), (None, URLS[0])], "page_id long, url string")
    got = url_filter.filter_urls(table.withColumns({"host": F.lit(1), "path": F.lit(2), "n": F.lit(3)})).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[r.page_id or 0]
        host, path = split(url)
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_tree_generalises_and_judges_by_purity(spark):
    rows = [f"http://h.net/shop/{i}/view" for i in range(200)] + [f"http://h.net/news/{i}.html" for i in range(200)]
    rows += [f"http://h.net/shop/{i}/more" for i in range(300, 340)] + [f"http://h.net/user{i}/x" for i in range(60)]
    rules = (("block", "h.net", "/shop/1"), ("allow", "h.net", "/news/1"), ("allow", "h.net", "/user1"))
    table = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r.page_id]: r for r in url_filter.filter_urls(table, rules).collect()}
    assert got["http://h.net/shop/77/view"].template == "h.net/shop/<n>/*"
    assert {r.verdict for u, r in got.items() if "/shop/" in u} == {"block"}
    assert {r.verdict for u, r in got.items() if "/news/" in u or "/user" in u} == {"allow"}
    assert got["http://h.net/user7/x"].template.startswith("h.net/*")


def test_no_labels_and_empty(spark):
    table = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {(r.page_id, r.verdict, r.purity) for r in url_filter.filter_urls(table).collect()} == {(1, "allow", 0.5), (2, "allow", 0.5)}
    assert url_filter.filter_urls(table.limit(0)).count() == 0


def wildcards(segments):
    return [s if s == url_filter.NUMBER else url_filter.ANY for s in segments]


def segments_of(path):
    parts = [s for s in path.replace("*", "%2A").replace("|", "%7C").replace("<", "%3C").split("/") if s]
    return [url_filter.NUMBER if re.fullmatch(r"[0-9]+(\.[a-z]{1,5})?", s) else s for s in parts]


def plain_tree(members, taken):
    """Templates of (index, segments, label) below one node, by the same rules; label is 1, 0 or None."""
    known = [label for _, _, label in members if label is not None]
    if not 0 < sum(known) < len(known):
        return {i: taken + wildcards(own[len(taken):]) for i, own, _ in members}
    out, below = {}, {}
    for i, own, label in members:
        if len(own) == len(taken):
            out[i] = taken
        else:
            below.setdefault(own[len(taken)], []).append((i, own, label))
    entries, rest_b, rest_k = [], 0, 0
    for segment, some in below.items():
        if segment == url_filter.NUMBER:
            continue
        b, k = sum(x[2] or 0 for x in some), sum(x[2] is not None for x in some)
        if len(some) >= url_filter.LEAST and len(some) >= url_filter.SUPPORT * len(members) and k:
            entries.append((b / k, segment, b, k))
        else:
            rest_b, rest_k = rest_b + b, rest_k + k
    if rest_k and entries:
        entries.append((rest_b / rest_k, url_filter.ANY, rest_b, rest_k))
    groups = []
    for _, segment, b, k in sorted(entries):
        if groups:
            names, b0, k0 = groups[-1]
            p = (b0 + b + 1) / (k0 + k + 2)
            if abs(b0 / k0 - b / k) <= url_filter.Z * (p * (1 - p) * (1 / k0 + 1 / k)) ** 0.5:
                groups[-1] = (names + [segment], b0 + b, k0 + k)
                continue
        groups.append(([segment], b, k))
    branch = {s: "|".join(sorted(names)) for names, _, _ in groups for s in names
              if len(groups) > 1 and url_filter.ANY not in names}
    nodes = {}
    for segment, some in below.items():
        nodes.setdefault(branch.get(segment, wildcards([segment])[0]), []).extend(some)
    for name, some in nodes.items():
        # The members' own segment is replaced by the branch, so that what is taken is a prefix of each.
        out |= plain_tree([(i, taken + [name] + own[len(taken) + 1:], label) for i, own, label in some], taken + [name])
    return out


def plain_filter(urls, rules):
    """(template, purity) of each url, by lists and loops."""
    def smoothed(some, above):
        labels = [x for x in some if x is not None]
        return (sum(labels) + url_filter.STRENGTH * above) / (len(labels) + url_filter.STRENGTH)

    hosts, label, out = {}, {}, {}
    for i, url in enumerate(urls):
        host, path = split(url)
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        label[i] = {"block": 1, "allow": 0}[max(fits)[1]] if fits else None
        hosts.setdefault(host, []).append((i, segments_of(path), label[i]))
    known = [x for x in label.values() if x is not None]
    prior = (sum(known) + 1) / (len(known) + 2)
    for host, members in hosts.items():
        site = ".".join(host.split(".")[-2:])
        of_site = smoothed([x[2] for h, m in hosts.items() if ".".join(h.split(".")[-2:]) == site for x in m], prior)
        of_host = smoothed([x[2] for x in members], of_site)
        templates = plain_tree(members, [])
        for i, template in templates.items():
            purity = of_host
            for d in range(1, len(template) + 1):
                purity = smoothed([label[j] for j, t in templates.items() if t[:d] == template[:d]], purity)
            out[i] = (host + "/" + "/".join(template), purity)
    return out


def test_tree_equals_a_plain_one(spark):
    r = random.Random(7)
    urls = []
    for _ in range(1500):
        host = r.choice(["a.net", "b.a.net", "c.org", "d.org"])
        path = [r.choice(["shop", "sale", "news", "blog", "wiki", "a*b", f"u{r.randrange(99)}"])]
        path += [r.choice(["x", "y", "z", str(r.randrange(40)), "p|q"]) for _ in range(r.randrange(4))]
        urls.append(f"http://{host}/" + "/".join(path))
    rules = [("block", "net", "/shop"), ("block", "net", "/sale/x"), ("allow", "net", "/news"), ("allow", "net", "/wiki/y"),
             ("block", "net", "/blog/x"), ("allow", "net", "/blog/y"), ("block", "net", "/blog/1"), ("allow", "net", "/sale/y/z"),
             ("block", "c.org", "/u1"), ("allow", "c.org", "/u2"), ("block", "c.org", "/a*b/p|q"), ("allow", "c.org", "/a*b/x")]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.template, x.purity) for x in url_filter.filter_urls(table, rules).collect()}
    want = plain_filter(urls, rules)
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
    names = {s for t, _ in got.values() for s in t.split("/")[1:]}
    assert any("|" in s for s in names) and {"*", "<n>"} < names and len(names) > 6


def test_similar_siblings_are_one_branch(spark):
    rows = [f"http://h.net/{s}/{i}" for s in ("ads", "promo", "news", "help") for i in range(40)]
    rules = (("block", "h.net", "/ads"), ("block", "h.net", "/promo"), ("allow", "h.net", "/news"), ("allow", "h.net", "/help"))
    table = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r.page_id].split("/")[3]: r.template for r in url_filter.filter_urls(table, rules).collect()}
    assert got == {"ads": "h.net/ads|promo/<n>", "promo": "h.net/ads|promo/<n>", "news": "h.net/help|news/<n>", "help": "h.net/help|news/<n>"}
