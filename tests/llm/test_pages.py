import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wayfold.llm import urlfilter, warc
from wayfold.llm.queries import URL_RULES

PAGE = "page_id long, url string, html string"


@pytest.fixture
def pages(spark):
    big, small = "<p>ä</p>" * 400, "<p>small</p>"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9\r\nWARC-Type: revisit", big), (3, None, small), (4, "http://b", small), (5, "x", None), (6, "y", ""), (7, "z", "q" * 1000), (None, "n", "m" * 2000), (9, "http://a/9", big)]
    return spark.createDataFrame(rows, PAGE).withColumn("content", F.lit("extra"))


def test_archive_round_trip(spark, pages, tmp_path):
    warc.write_archive(pages, f"{tmp_path}/a")
    records = warc.read_records(spark, f"{tmp_path}/a").collect()
    assert len(records) == 10
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert rest[length:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        assert b"WARC-Type: " + r.record_type.encode() in head
        http, _, body = rest[:length].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        assert body == bytes(r.payload or b"")
    facts = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.payload_facts(warc.read_records(spark, f"{tmp_path}/a")).collect()), key=str)
    expected = []
    for page, _, html, _ in pages.collect():
        raw = (html or "").encode()
        revisit = page in (1, 2)
        expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert facts == sorted(expected, key=str)
    stored = spark.read.parquet(f"{tmp_path}/a/payloads")
    assert stored.count() == stored.select("sha256").distinct().count() == 5


def test_damage_is_noticed(spark, pages, tmp_path):
    warc.write_archive(pages, f"{tmp_path}/a")
    spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("content", F.concat("content", F.lit("!").cast("binary"))).write.parquet(f"{tmp_path}/b")
    (tmp_path / "a/payloads").rename(tmp_path / "a/old")
    (tmp_path / "b").rename(tmp_path / "a/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(spark, f"{tmp_path}/a").collect()


def test_empty_archive(spark, pages, tmp_path):
    warc.write_archive(pages.limit(0), f"{tmp_path}/a")
    assert warc.payload_facts(warc.read_records(spark, f"{tmp_path}/a")).collect() == []


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://A.Example.NET/en/1", "https://example.net/EN/x?y#z", "ftp://example.net", "x.net/en/", None, "", "http://", "http://net?q", "http://net/", "HTTP://sub.ORG/fr/a#b",
        "http://example.com/de/", "http://notexample.com/de/", "http://é.org/fr/", "a://b://c/d", "http://h/\n/x?y",
    ]
    rows = urlfilter.judge_urls(spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string"), URL_RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rest = (urls[r.page_id] or "").partition("://")[2]
        host, path = re.match(r"[^/?#]*", rest).group(), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule[1])
        assert r.verdict == (rule[2] or r.verdict) in ("allow", "block")


def test_templates_block_what_their_labels_say(spark):
    rows = [(k, f"http://h.x/shop/item-{k}/view", None) for k in range(60)] + [(100 + k, f"http://h.x/blog/{k}.html", None) for k in range(60)] + [(200 + k, f"http://h.x/{w}/a", None) for k, w in enumerate("abcdefghijklmnopqrst")]
    pages = spark.createDataFrame(rows, PAGE)
    rules = [("block", "h.x", f"/shop/item-{k}/") for k in range(30)] + [("allow", "h.x", f"/blog/{k}.") for k in range(30)]
    found = {r.page_id: r for r in urlfilter.judge_urls(pages, rules).collect()}
    assert {found[k].template for k in range(60)} == {"/shop/item-{n}/view"}
    assert {found[k].verdict for k in range(60)} == {"block"}
    assert {found[100 + k].verdict for k in range(60)} == {"allow"}
    assert {found[200 + k].template for k in range(20)} == {"/*/a"}
    assert urlfilter.judge_urls(pages.limit(0), rules).collect() == []


def plain_templates(rows):
    """Templates of (host, shapes, blocked) by nested loops over a dictionary of paths: {(host, shapes): (template, rejected)}."""
    paths = {}
    for host, shapes, blocked in rows:
        n, labels, bad = paths.get((host, shapes), (0, 0, 0))
        paths[host, shapes] = n + 1, labels + (blocked is not None), bad + (blocked or 0)
    steps = {key: list(key[1]) for key in paths}
    for level in range(max((len(s) for s in steps.values()), default=0)):
        branches = {}
        for key, now in steps.items():
            if len(now) > level:
                branches.setdefault((key[0], *now[:level]), []).append(key)
        for keys in branches.values():
            kinds = len({steps[k][level] for k in keys})
            if kinds >= urlfilter.MANY and sum(paths[k][0] for k in keys) < urlfilter.FEW_PAGES * kinds:
                for k in keys:
                    steps[k][level] = "*"

    def total(keys):
        return tuple(map(sum, zip(*(paths[k] for k in keys))))

    def near(part, whole, all_part, all_whole):
        share = all_part / max(all_whole, 1)
        return whole == 0 or abs(part / whole - share) <= urlfilter.ALIKE * (share * (1 - share) / whole) ** 0.5 + 0.02

    for level in reversed(range(max((len(s) for s in steps.values()), default=0))):
        templates, families = {}, {}
        for key, now in steps.items():
            templates.setdefault((key[0], tuple(now)), []).append(key)
        for host, now in templates:
            if len(now) > level:
                families.setdefault((host, now[:level], now[level + 1 :]), []).append((host, now))
        for family in families.values():
            all_n, all_labels, all_bad = total([k for t in family for k in templates[t]])
            for t in family if len(family) > 1 else []:
                n, labels, bad = total(templates[t])
                if near(labels, n, all_labels, all_n) and near(bad, labels, all_bad, all_labels):
                    for k in templates[t]:
                        steps[k][level] = "*"
    templates = {}
    for key, now in steps.items():
        templates.setdefault((key[0], tuple(now)), []).append(key)
    _, all_labels, all_bad = total(paths) if paths else (0, 0, 0)
    share, out = all_bad / max(all_labels, 1), {}
    for (_, now), keys in templates.items():
        _, labels, bad = total(keys)
        for k in keys:
            out[k] = "".join(f"/{x}" for x in now), (bad + urlfilter.PRIOR * share) / (labels + urlfilter.PRIOR) >= urlfilter.REJECT
    return out


def test_deep_branches_are_told_apart(spark):
    """Pages that differ only below many common segments: those of the bad branch that no rule names are blocked."""
    rows = [(k, f"http://h.x/a/b/c/d/{'bad' if k < 40 else 'good'}/{k}-", None) for k in range(80)]
    rules = [("block" if k < 40 else "allow", "h.x", f"/a/b/c/d/{'bad' if k < 40 else 'good'}/{k}-") for k in [*range(35), *range(40, 75)]]
    found = {r.page_id: r for r in urlfilter.judge_urls(spark.createDataFrame(rows, PAGE), rules).collect()}
    assert {found[k].verdict for k in range(40)} == {"block"} and {found[k].verdict for k in range(40, 80)} == {"allow"}
    assert {found[k].template for k in range(40)} == {"/a/b/c/d/bad/{n}-"}


def test_tree_equals_nested_loops(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(900):
        host, depth = rng.choice(["a.x", "a.x", "b.y"]), rng.choice([0, 1, 2, 3, 3, 6])
        shapes = tuple(rng.choice(["p", "q", "r", f"v{rng.randrange(40)}" if level == 1 else "s"]) for level in range(depth))
        blocked = None if rng.random() < 0.4 else int("q" in shapes) if rng.random() < 0.95 else rng.randrange(2)
        rows.append((host, shapes, blocked))
    table = spark.createDataFrame([(h, list(s), b) for h, s, b in rows], "host string, shapes array<string>, blocked int")
    found = {(r.host, tuple(r.shapes)): (r.template, r.rejected) for r in urlfilter.template_verdicts(table).collect()}
    assert found == plain_templates(rows)
    assert len({t for t, _ in found.values()}) < len(found) and any(bad for _, bad in found.values())
