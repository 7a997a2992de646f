"""op3 over all pages against a plain parse."""

import re

from attest.llm import catalog, urls

SF = "/root/testdata/sf0.001"


def parsed(url):
    """(host, path, rule, verdict of the rule) of a url."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_query_on_all_pages(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
        got = catalog.QUERIES["op3_url_trees"](spark, sf).collect()
        assert len(got) == len(pages) and {r.page_id for r in got} == set(pages)
        assert {parsed(u)[3] for u in pages.values()} == {"allow", "block", None}
        for r in got:
            host, path, rule, verdict = parsed(pages[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_copies_of_one_url_leave_room_for_both_labels(spark):
    """The labelled url of smallest hash, repeated, would fill a sample of rows alone."""
    made = [(f"http://b{i}.net/x", f"http://a{i}.org/fr/x") for i in range(30)]
    order = {r.u: r.h for r in spark.createDataFrame([(u,) for pair in made for u in pair], "u string").selectExpr("u", "xxhash64(u) as h").collect()}
    blocked, allowed = [b for b, _ in made], [a for _, a in made]
    hot = min(blocked, key=order.get)
    allowed = [a for a in allowed if order[a] > order[hot]]
    assert allowed
    rows = [hot] * 500 + allowed + ["http://new.org/de/1"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.url: r.verdict for r in urls.judged(pages, train_rows=20).select("url", "verdict").collect()}
    assert got["http://new.org/de/1"] == "allow" and got[hot] == "block"


def made_urls(n=1500):
    """Shops on .net whose long query strings and digits give them away, and plain pages on .org/fr, each host with a few pages."""
    import random
    draw, rows = random.Random(6), []
    for i in range(n):
        bad = i % 2
        host = f"h{draw.randrange(n // 5)}{'b' if bad else 'g'}"
        if bad:
            rows.append(f"http://{host}.net/buy/{draw.randrange(10**9)}?id={draw.randrange(10**9)}&ref={draw.randrange(10**6)}")
        else:
            rows.append(f"http://{host}.org/fr/" + "/".join(draw.choice(["news", "about", "people", "history"]) for _ in range(3)))
    return rows


def area(rows):
    """Share of (blocked, allowed) pairs whose scores are in order, ties half."""
    blocked, allowed = [r.s for r in rows if r.label == 1], [r.s for r in rows if r.label == 0]
    return sum((b > a) + 0.5 * (b == a) for b in blocked for a in allowed) / (len(blocked) * len(allowed))


def scores_of_held_out_hosts(spark, pages):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F
    labelled = urls.labelled_urls(urls.ruled(pages))
    model = urls.Filter(labelled.filter("fold <> 0"))
    out = model.applied(labelled.filter("fold = 0"), "blocked", "chance")
    return out.select("label", vector_to_array("chance")[1].alias("s"), "url").collect()


def test_labels_of_held_out_hosts(spark):
    rows = scores_of_held_out_hosts(spark, spark.createDataFrame(list(enumerate(made_urls())), "page_id long, url string"))
    assert len(rows) > 100 and area(rows) >= 0.95


def test_held_out_hosts_of_the_pages(spark):
    rows = scores_of_held_out_hosts(spark, spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url"))
    assert len({r.label for r in rows}) == 2 and area(rows) >= 0.7


def test_trees_do_not_repeat_the_suffix(spark):
    """Two suffixes that rules never name: pages of both that look like shops are blocked, others are not."""
    known = made_urls()
    new = [u.replace(".net/", ".xyz/").replace(".org/", ".xyz/") for u in made_urls(400)]
    pages = spark.createDataFrame(list(enumerate(known + new)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judged(pages).filter(f"page_id >= {len(known)}").collect()}
    right = sum((r.verdict == "block") == ("buy" in r.url) for r in got.values())
    assert {r.rule for r in got.values()} == {None} and right >= 0.9 * len(new)
