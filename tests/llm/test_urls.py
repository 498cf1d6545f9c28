"""URL filters against a brute force: parsing, fixed rules, mined rules and the verdicts they give."""

import itertools
import re

from mailtables.llm import urls


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host):]).group(0)
    return host.translate(str.maketrans(urls.UPPER, urls.LOWER)), path


def fixed(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def items(url, host, path):
    labels = host.split(".")
    found = [f"host:{'.'.join(labels[i:])}" for i in range(len(labels)) if ".".join(labels[i:])]
    found += [f"label:{x}" for x in labels if x]
    parts = path.split("/")[1:-1] if path.startswith("/") else []
    found += [f"dir:/{'/'.join(parts[:i + 1])}/" for i in range(len(parts))]
    query = re.search(r"\?([^#]*)", url or "")
    found += [f"query:{m}" for m in re.findall(r"(?:^|&)([^=&]+)", query.group(1) if query else "")]
    return set(found)


def brute(rows, support=urls.MIN_SUPPORT, confidence=urls.MIN_CONFIDENCE):
    distinct = {url for _, url in rows}
    parsed = {u: parse(u) for u in distinct}
    labelled = [(items(u, *parsed[u]), fixed(*parsed[u])[1]) for u in distinct if fixed(*parsed[u])[0]]
    rules = {}
    candidates = {c for t, _ in labelled for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), k)}
    n = len(labelled)
    for combo in candidates:
        having = [v for t, v in labelled if set(combo) <= t]
        if len(having) < support * n:
            continue
        for verdict in ("allow", "block"):
            right = having.count(verdict)
            if right >= support * n and right / len(having) >= confidence:
                rules[" ".join(combo)] = (verdict, right / len(having), right / n, len(combo))
    out = []
    for page_id, url in rows:
        host, path = parse(url)
        rule, verdict = fixed(host, path)
        learned = None
        if rule is None:
            have = items(url, host, path)
            fitting = [(-c, -s, k, name, v) for name, (v, c, s, k) in rules.items() if set(name.split(" ")) <= have]
            if fitting:
                best = min(fitting)
                learned, verdict = best[3], best[4]
            else:
                verdict = urls.OTHERWISE
        out.append((page_id, host, path, rule, verdict, learned))
    return sorted(out, key=repr), rules


def run(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'x' AS rule", "1 AS host")
    got = urls.judged(pages).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_fixed_rules_and_odd_urls(spark):
    odd = [None, "", "no scheme/net/", "HTTP://Example.NET/en/x", "http://net/", "http://x.net", "http://fnet/",
           "http://a.example.com/de/x?q=1#f", "http://a.example.com/de", "https://org/fr/", "ftp://x.org/fr/a",
           "http://x.org?/fr/", "://net/", "http://A.B.EXAMPLE.NET/en/?x=1", "http://a.example.com/DE/", "é://net/é"]
    rows = [(i, u) for i, u in enumerate(odd)] + [(None, "http://net/"), (3, "HTTP://Example.NET/en/x")]
    want, _ = brute(rows)
    got = run(spark, rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert run(spark, []) == []


def test_mined_rules_and_verdicts(spark):
    hosts = ["a.example.net", "b.example.net", "shop.example.com", "news.example.org", "cheap-pills.example.com"]
    dirs = ["/en/", "/de/", "/fr/", "/es/", "/"]
    rows = []
    for i in range(600):
        url = f"http://{hosts[i % 5]}{dirs[(i // 5) % 5]}{i % 13}" + ("?page=2&ref=x" if i % 3 == 0 else "")
        rows.append((i, url))
    rows += [(1000 + i, "http://cheap-pills.example.com/en/1") for i in range(300)]  # one hot URL
    want, rules = brute(rows)
    assert rules and any(w[3] is None and w[5] is not None for w in want)
    got = run(spark, rows)
    assert got == want
