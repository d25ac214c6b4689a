import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, url_filter, warc

# --- embeddings


def brute(rows):
    good = {}
    for k, v in rows:
        if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0:
            good.setdefault(k, np.asarray(v, float) / np.linalg.norm(v))
    keys = sorted(good)
    x = np.stack([good[k] for k in keys])
    linked = x @ x.T >= 0.9 - 1e-12
    np.fill_diagonal(linked, False)
    label = np.arange(len(keys))
    while True:
        new = np.array([min(label[i], label[linked[i]].min()) if linked[i].any() else label[i] for i in range(len(keys))])
        if (new == label).all():
            break
        label = new
    out = {k: (0, k) for k, _ in rows if k is not None}
    out.update({k: (int(linked[i].sum()), keys[label[i]]) for i, k in enumerate(keys)})
    return out


def vectors(dim=64, groups=6, each=60, loose=400, noise=0.25):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(groups):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        rows += [centre + noise * rng.standard_normal(dim) / np.sqrt(dim) for _ in range(each)]
    rows += list(rng.standard_normal((loose, dim)))
    rows += [rows[0]] * 5 + [rows[1] * 7.5]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_links_match_brute_force(spark):
    rows = vectors()
    rows += [(5_000, None), (5_001, [0.0] * 64), (5_002, [float("nan")] * 64), (5_003, [float("inf")] + [0.0] * 63),
             (5_004, [None] + [1.0] * 63), (5_005, [1.0, 2.0]), (3, rows[3][1])]
    d = spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id long, embedding array<double>, n_links int, kept boolean").repartition(4)
    out = embedding_dedup.dedup_embeddings(d)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = result(out), brute([r for r in rows if r[1] is None or len(r[1]) == 64] + [(5_005, None)])
    assert set(got) == set(want)
    near = sum(min(got[k][0], want[k][0]) for k in want) / sum(v[0] for v in want.values())
    assert near >= 0.99 and all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.99 * len(want)


def test_close_links_are_all_found_across_blocks(spark, monkeypatch):
    rows = vectors(noise=0.1)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(embedding_dedup.dedup_embeddings(d)) == brute(rows)


def test_null_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, None)], "vec_id long, embedding array<double>")
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in embedding_dedup.dedup_embeddings(d).collect()) == [
        ("1", 0, True), ("None", 0, True), ("None", 0, True)]
    assert embedding_dedup.dedup_embeddings(d.limit(0)).isEmpty()


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    exact = x @ x.T
    errors = []
    for number in range(20):
        turned = x @ embedding_dedup.rotation(64, number)
        signs, factors = embedding_dedup.code(turned)
        guess, error = embedding_dedup.estimates(signs, factors, turned)
        off = ~np.eye(300, dtype=bool)
        errors.append((guess - exact)[off].mean())
        assert (np.abs(guess - exact)[off] <= embedding_dedup.SIGMAS * np.broadcast_to(error, exact.shape)[off]).mean() > 0.9999
    assert abs(np.mean(errors)) < 0.005


# --- urls

def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c)[0]
    best = None
    for r in url_filter.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.key) > len(best.key)):
            best = r
    return host, path, best and best.key, best.action if best else "allow"


URLS = [None, "", "no scheme", "http://a.example.com/en/1", "https://WWW.Example.com/en/x?y#z", "http://example.com/en", "http://example.com",
        "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://a.org/fr/1", "http://a.com?x=/en/", "http://a.com/fr/#t://b",
        "ftp://ÄÖ.example.com/en/", "http://" + "a." * 500 + "com/" + "p" * 5_000, "http://a.com/en/1", "http://a.com/en/1", "http:///en/", "://net/es/"]


def test_urls_match_plain_rules(spark):
    d = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    out = url_filter.judge_urls(d, url_filter.RULES)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in out.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(r["url"])
    assert url_filter.judge_urls(d.limit(0), url_filter.RULES).isEmpty()
    assert {r["verdict"] for r in url_filter.judge_urls(d, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 20_000, 7)] + ["not in the universe"]
    cascade = url_filter.Cascade(universe, listed)
    assert len(cascade.levels) > 1
    got = {r["key"] for r in universe.where(cascade.contains(F.col("key"))).collect()}
    assert got == set(listed) - {"not in the universe"}
    assert universe.where(url_filter.Cascade(universe, []).contains(F.col("key"))).isEmpty()


# --- warc

def test_captures_match_plain_digests(spark):
    same = "<p>" + "copy " * 40 + "</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response"
    rows = [(5, "http://a.com/x", same), (3, "http://b.com/", same), (9, None, same), (9, None, same), (1, "u", None), (2, "u", ""), (4, "u", "tiny"),
            (6, "http://ü.com/ü", "tiny"), (7, "a\r\nb", "é" * 60_000), (None, "http://n.com", "no id"), (None, None, same), (8, "z", "x\r\n\r\n")]
    d = spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, url string, html string, record_type string")
    captures = warc.archive_and_read(d)
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    want = Counter()
    for k, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and (k is None or k > first[h or ""])
        want[(k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None)] += 1
    assert Counter(map(tuple, warc.digest_rows(captures).collect())) == want
    nested = captures.where("response.page_id = 8").first()
    assert nested["response"]["payload"] == "x\r\n\r\n" and "GET" in nested["request"]["block"] and "payloadBytes: 5" in nested["metadata"]["block"]
    assert warc.archive_and_read(d.limit(0)).isEmpty()


def test_records_need_not_be_neighbours(spark):
    d = spark.createDataFrame([(i, f"http://a/{i}", f"text {i}") for i in range(30)], "page_id long, url string, html string")
    folder = warc.new_folder(spark, "warc")
    warc.write_captures(d, folder)
    records = warc.read_records(spark, folder)
    assert Counter(r["kind"] for r in records.collect()) == {"request": 30, "response": 30, "metadata": 30}
    mixed = records.where("kind <> 'request' or page_id <> 3").orderBy(F.rand(1))
    out = {r["response"]["page_id"]: r for r in warc.assemble(mixed).collect()}
    assert len(out) == 30 and out[3]["request"] is None and out[4]["request"] is not None


def test_broken_archives_raise():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"HTTP/1.1 200 OK\r\n\r\n"))
