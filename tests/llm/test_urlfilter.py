"""Rules and propagation against a plain version."""

import random
import re
from collections import defaultdict

from covenant.llm import urlfilter as U
from covenant.llm.queries import URL_RULES


def plain(pages, rules, steps=U.STEPS, d=U.DAMPING):
    """(host, path, rule, ruled verdict) by page and (trust, distrust) by host."""
    at, edges = {}, defaultdict(float)
    for pid, url, _ in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(str(r)), default=None)
        at[pid] = (host, path, best and str(best), best and best.verdict)
    hosts = {h for h, *_ in at.values() if h}
    known = set(hosts)
    for pid, _, html in pages:
        for link in re.findall(U.LINK, html or ""):
            host = re.match(r"^(?:[a-zA-Z]*:)?//([^/?#]*)", link)[1].lower()
            if at[pid][0] and host and host != at[pid][0]:
                edges[at[pid][0], host] += 1
                known.add(host)
    steps_up = set()
    for h in known:
        while h.count(".") >= 2:
            steps_up.add((h, h := h.split(".", 1)[1]))
    for h, up in steps_up:
        edges[h, up] += 1
        edges[up, h] += 1
    seed = [defaultdict(float), defaultdict(float)]
    for n, verdict in enumerate(("allow", "block")):
        own = [h for h, _, _, v in at.values() if v == verdict and h]
        for h in own:
            seed[n][h] += (1 - d) / len(own)
    rank = [dict(s) for s in seed]
    out, into = defaultdict(float), defaultdict(float)
    for (a, b), w in edges.items():
        out[a] += w
        into[b] += w
    for _ in range(steps):
        new = [defaultdict(float, s) for s in seed]
        for (a, b), w in edges.items():
            new[0][b] += d * w / out[a] * rank[0].get(a, 0)
            new[1][a] += d * w / into[b] * rank[1].get(b, 0)
        rank = new
    return at, rank


def check(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in U.judge(df, URL_RULES).collect()}
    at, rank = plain(pages, URL_RULES)
    assert len(got) == len(pages)
    for pid, (host, path, rule, verdict) in at.items():
        r = got[pid]
        trust, distrust = (round(x.get(host, 0.0), 12) for x in rank)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert abs(r.trust - trust) < 1e-9 and abs(r.distrust - distrust) < 1e-9
        assert r.verdict == (verdict or ("block" if distrust > trust + 1e-9 else "allow"))
    return got


def test_against_a_plain_version(spark):
    rng = random.Random(2)
    hosts = [f"{a}{b}.example.{t}" for a in ("", "www.", "M.") for b in "xyz" for t in ("com", "net", "org")] + ["spam.test", "hub.test"]
    pages = []
    for i in range(200):
        host = "hub.test" if i % 3 == 0 else rng.choice(hosts)         # a third of all pages on one host
        links = "".join(f'<a class=c HREF="{rng.choice(["https:", "http:", ""])}//{rng.choice(hosts)}/p">x</a>' for _ in range(rng.randrange(4)))
        pages.append((i, f"https://{host}/{rng.choice(['fr', 'de', 'en', 'es'])}/{rng.randrange(300)}?q#f", f'<a href="/own">o</a>{links}'))
    got = check(spark, pages)
    assert {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"}


def test_hosts_of_a_site_hang_together_without_pages_between_them(spark):
    got = check(spark, [(1, "http://a.x.example.org/es/1", None), (2, "http://b.y.example.org/en/5", None),
                        (3, "http://c.d.y.example.com/de/1", None), (4, "http://q.example.com/it/", None), (5, "http://other.net/", None)])
    assert got[2].rule == "org/" and got[4].verdict == "block" and got[4].distrust > 0 and got[5].distrust == 0


def test_urls_without_host_and_null_columns(spark):
    got = check(spark, [(1, None, "<a href='//a.org/'>"), (2, "no scheme", None), (3, "http://A.ORG", ""), (4, "x://a.com/fr/?b", None),
                        (5, "http://a.example.org/es/x/http://b.com/", None), (6, "http://a.com/de/", None), (7, "", None)])
    assert got[1].verdict == "allow" and got[1].host == "" and got[3].rule is None and got[4].rule == "com/fr/"
    assert got[5].verdict == "block"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert U.judge(empty, URL_RULES).count() == 0
    extra = spark.createDataFrame([(1, "http://a.org/", None, "x", 1.0)], "page_id long, url string, html string, verdict string, trust double")
    assert U.judge(extra, URL_RULES).first().verdict == "allow"
    assert U.judge(extra, []).first().rule is None
