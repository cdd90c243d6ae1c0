import collections
import math

import pandas as pd

from larkspan.llm import urls


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    best = None
    for _, rule in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


URLS = ["http://A.Example.org/en/12?x#y", "https://example.org/es/", "https://example.org", "x", None, "", "://", "ftp://b.com/de/1", "http://com/fr/a", "http://notorg/a", "http://é.ORG/", "http://a.org?b/c", "a://b://c.org/", "http://a.com/de", "http://a.net/\nx"]


def pages(spark):
    more = [f"https://{'spam' if k % 2 else 'good'}{k}.example.{'com/de' if k % 2 else 'org/en'}/{'pills' if k % 2 else 'news'}/{k}" for k in range(200)]
    more += [f"https://x{k}.example.net/en/{'pills' if k % 2 else 'news'}/{k}" for k in range(40)]
    return spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + more)], "page_id long, url string, host string")


def test_parts_rules_and_verdicts(spark):
    rows = urls.filter_urls(pages(spark)).collect()
    says = {r: v for v, r in urls.RULES}
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == brute(r["url"])
        assert r["verdict"] == says.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block")
    judged = [r for r in rows if r["rule"] is None]
    allowed, blocked = ([r["score"] for r in judged if r["verdict"] == v] for v in ("allow", "block"))
    assert min(allowed) > max(blocked) and {r["score"] for r in judged if "://" not in (r["url"] or "")} == {0.0}
    net = [r for r in rows if r["host"].endswith(".net") and r["host"].startswith("x")]
    assert sum((r["verdict"] == "block") == ("pills" in r["path"]) for r in net) >= 0.9 * len(net)


def test_empty_and_one_sided(spark):
    frame = pages(spark)
    assert urls.filter_urls(frame.limit(0)).count() == 0
    one_sided = urls.filter_urls(frame.where("url LIKE '%good%' OR url LIKE 'https://x%'")).where("rule IS NULL AND host <> ''")
    assert {r["verdict"] for r in one_sided.collect()} == {"allow"}


def by_definition(accepted, rejected, url):
    """The mean log ratio a symbol of two Witten-Bell models, each counted and interpolated as it is defined."""
    code = lambda u: [0] * urls.ORDER + [int(c) for c in urls._symbols(pd.Series([u]))[0][urls.ORDER :]]

    def model(texts):
        seen = collections.Counter()
        for u in texts:
            c = code(u)
            for i in range(urls.ORDER, len(c)):
                for k in range(urls.ORDER + 1):
                    seen[tuple(c[i - k : i + 1])] += 1
        after = collections.defaultdict(list)
        for gram, n in seen.items():
            after[gram[:-1]].append(n)

        def p(gram):
            lower = p(gram[1:]) if len(gram) > 1 else 1 / urls.N
            counts = after[gram[:-1]]
            return (seen[gram] + len(counts) * lower) / (sum(counts) + len(counts)) if sum(counts) >= urls.LEAST else lower

        return p

    good, bad, c = model(accepted), model(rejected), code(url)
    each = [math.log(good(tuple(c[i - urls.ORDER : i + 1])) / bad(tuple(c[i - urls.ORDER : i + 1]))) for i in range(urls.ORDER, len(c))]
    return sum(each) / len(each)


def test_ratio_against_its_definition(spark):
    accepted, rejected = [f"news{k % 7}.org/en/{k}" for k in range(60)], [f"pills{k % 5}.com/de/buy-{k}" for k in range(50)]
    table = urls.fit_ratio(spark.createDataFrame([(u, True) for u in accepted] + [(u, False) for u in rejected], "u string, accepted boolean"))
    probes = ["news1.org/en/5", "pills.com/x", "é?", "a"]
    scores = urls.ratio_scores(pd.Series(probes), table)
    assert all(abs(s - by_definition(accepted, rejected, u)) < 1e-4 for s, u in zip(scores, probes))


def test_threshold_is_the_nearest_to_zero_within_a_standard_error(spark):
    at = lambda *groups: urls.threshold(spark.createDataFrame([(x, ok) for x, ok, n in groups for _ in range(n)], "score double, accepted boolean"))
    assert abs(at((-2.0, False, 50), (3.0, True, 50))) < 0.03  # the whole gap is as good
    assert abs(at((-2.0, False, 50), (-1.0, True, 1), (3.0, True, 49))) < 0.03  # one row is less than a standard error
    assert -2 < at((-2.0, False, 5000), (-1.0, True, 500), (3.0, True, 4500)) <= -1  # many aren't
    assert at((3.0, True, 5)) == 0.0
