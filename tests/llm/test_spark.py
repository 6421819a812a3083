"""Operators on Spark: odd inputs, brute force on small tables, the pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from spanloom.llm import chunked_bpe, common, components, fingerprint, gam, knn, langid, mixing, neardup, pii, prefix_tokens, queries, sql, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ODD = [
    (1, None, "en", None, None), (2, "", None, "s", 0), (3, "a b c d e f", "en", "s", 11), (4, "a b c d e f", "en", "s", 11), (4, "a b c d e f", "en", "s", 11),
    (None, "no id here at all", "en", "s", 17), (5, LONG, "fr", "hot", len(LONG)), (6, "x@y.zz 10.0.0.1", None, None, 15), (7, "   ", "de", "s", 3), (-8, "a b c d e f", "en", "s", 11),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def extra(df):
    """Columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for c in ("node", "kind", "score", "version", "key", "x", "salt", "root"):
        df = df.withColumn(c, F.lit(1))
    return df


def test_fingerprints_of_odd_rows(spark, odd):
    got = fingerprint.fingerprints(extra(odd)).collect()
    assert len(got) == len(ODD)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    order.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = defaultdict(list)
    for k, r in enumerate(order):
        t, n = r[1] or "", order[(k + 1) % len(order)][1] or ""
        want[r[0]].append(hashlib.sha256(fingerprint.edited(t, n).encode()).hexdigest())
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append(r.edited_sha256)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert fingerprint.fingerprints(odd.limit(0)).count() == 0
    assert fingerprint.fingerprints(odd.filter("doc_id = 3")).first()["near_next"] == 1.0


def test_bpe_of_odd_rows(spark, odd):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = chunked_bpe.encode(extra(odd), P.path("byte_bpe_50k.json"), with_ids=True).collect()
    want = sorted((str(r[0]), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    back = chunked_bpe.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), P.path("byte_bpe_50k.json")).collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in ODD)
    assert chunked_bpe.encode(odd.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_shared_chunks_are_exact(spark):
    random.seed(3)
    words = ["thing", "ander", "était", "niño", "x1", "don't", "(a)", "  ", "\n"]
    body = " ".join(random.choice(words) for _ in range(3000))
    rows = [(k, f"{'start ' * k}{body[k * 50:]}{'end' * k}") for k in range(8)] + [(20, body), (21, body), (22, "<|endoftext|>" + body)]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {k: hashlib.sha256(",".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest() for k, x in rows}
    got = chunked_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.ids_sha256 for r in got} == want


def test_pii_and_tokens_of_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_email, r.n_ip) for r in pii.find(extra(odd)).collect()}
    assert (6, 1, 1) in got and (1, 0, 0) in got
    kept = pii.redact(extra(odd))
    assert kept.columns == extra(odd).columns and kept.count() == len(ODD)
    assert kept.filter("doc_id = 6").first()["text"] == "<EMAIL> <IP>" and kept.filter("doc_id = 1").first()["text"] is None
    n = {r.doc_id: (r.n_tokens, r.over_limit, r.fit_chars) for r in prefix_tokens.count_tokens(odd, P.path("piece_bpe_32k.model")).collect()}
    assert n[1] == (0, False, 0) and n[5][1] and n[5][2] < len(LONG)


def brute_components(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    up = {i: i for i in sets}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent", "rows"), [(3, 85, 7), (5, 80, 6)])
def test_near_duplicates_by_brute_force(spark, n, percent, rows):
    random.seed(n)
    data = []
    for g in range(12):
        base = [f"w{random.randint(0, 400)}" for _ in range(random.randint(4, 160))]
        for _ in range(random.randint(1, 30 if g else 300)):
            w = base[:]
            for _ in range(random.randint(0, 6)):
                w[random.randrange(len(w))] = f"e{random.randint(0, 99)}"
            data.append((len(data), " ".join(w)))
    data += [(9000, None), (9001, ""), (9002, "One two"), (9003, "one\ttwo "), (9004, "one")]
    got = neardup.assign(spark.createDataFrame(data, "doc_id long, text string"), n, percent, rows).collect()
    want = brute_components(data, n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_families_by_brute_force(spark, monkeypatch):
    """Large families by hubs and open buckets, small blocks, hot keys broadcast: the same components."""
    random.seed(11)
    chain = [f"c{k}" for k in range(300)]
    data = [(k, " ".join(chain[3 * k : 3 * k + 60])) for k in range(70)]  # each like its neighbours only
    base = [f"w{k}" for k in range(80)]
    for g in range(110):
        w = base[:]
        for _ in range(random.randint(1, 9)):
            w[random.randrange(80)] = f"e{random.randint(0, 30)}"
        data.append((1000 + g, " ".join(w)))
    data += [(2000 + k, "the very same words again and again in every copy") for k in range(60)]
    random.shuffle(data)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "FAMILY", 20)
    monkeypatch.setattr(common, "HOT_ROWS", 25)
    monkeypatch.setattr(common, "HOT_SHARE", 0)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = neardup.assign(df, 3, 85, 7).collect()
    want = brute_components(data, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_of_odd_rows(spark, odd):
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.assign(extra(odd), 3, 85, 7).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, -8, False), (4, -8, False), (None, None, True), (5, 5, True), (6, 6, True), (7, 7, True), (-8, -8, True)}
    kept = neardup.keep_one(extra(odd), 3, 85, 7)
    assert kept.columns == extra(odd).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["-8", "1", "2", "5", "6", "7", "None"]
    assert neardup.assign(odd.limit(0)).count() == 0 and neardup.keep_one(odd.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "quite another text of seven words here"
    df = spark.createDataFrame([(2, b), (5, a), (5, b), (9, a), (9, a), (1, c), (1, a + " x"), (7, c)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in neardup.assign(df, 3, 85, 7).collect()}
    assert got == {(2, 2), (5, 2), (9, 2), (1, 1), (7, 1)}
    # texts are what is thinned out: every distinct one stays, once
    assert sorted((r.doc_id, r.text) for r in neardup.keep_one(df, 3, 85, 7).collect()) == sorted([(2, b), (5, a), (1, c), (1, a + " x")])


def test_components(spark):
    random.seed(3)
    for n, pairs in ((60, [(random.randrange(60), random.randrange(60)) for _ in range(45)]), (50, [(k, k + 1) for k in range(49)]), (9, [])):
        up = list(range(n))

        def top(v, up=up):
            while up[v] != v:
                v = up[v]
            return v

        for a, b in pairs:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
        got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == {v: top(v) for p in pairs if p[0] != p[1] for v in p}


def brute_rake(cells, targets, rounds):
    w = dict(cells)
    for _ in range(rounds):
        for d, want in enumerate(targets):
            mass = defaultdict(float)
            for c, x in w.items():
                mass[c[d]] += x
            w = {c: x * want[c[d]] / mass[c[d]] if mass[c[d]] else 0.0 for c, x in w.items()}
    return w


def test_mixture(spark, odd):
    got = mixing.weights(extra(odd))
    assert got.count() == len(ODD) and all(0 <= r.prob <= 1 for r in got.collect())
    assert mixing.weights(odd.limit(0)).count() == 0
    rows = [(k, "x " * 100, "en" if k % 10 else "fr", f"s{k % 3}", 400) for k in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.weights(df, targets={"lang": {"fr": 0.3, "en": 0.7}}, keep=0.5).collect()
    kept = [r for r in out if r.kept]
    mass = sum(r.prob for r in out if r.lang == "fr") / sum(r.prob for r in out)
    assert 0.44 < len(kept) / len(out) < 0.56 and mass > 0.15 and {r.n_tokens for r in out} == {100} and out[0].marginal_error == 0
    small, mixing.CELLS = mixing.CELLS, 0
    try:
        salted = {r.doc_id: (r.kept, r.prob) for r in mixing.weights(df, rounds=3).collect()}
    finally:
        mixing.CELLS = small
    assert salted == {r.doc_id: (r.kept, r.prob) for r in mixing.weights(df, rounds=3).collect()}


def test_raking_by_brute_force(spark):
    random.seed(4)
    cells = {(f"s{a}", b, c): random.randint(1, 900) for a in range(4) for b in ("en", "fr", None) for c in ("long", "brief") if random.random() < 0.8}
    total = sum(cells.values())
    share = {c: n / total for c, n in cells.items()}
    named = {"lang": {"en": 0.6, "fr": 0.3, "xx": 0.4}, "topic": {"long": 0.5, "brief": 0.5}}
    seen = [defaultdict(float) for _ in range(3)]
    for c, n in cells.items():
        for d in range(3):
            seen[d][c[d]] += n
    raw = [{v: n**0.7 for v, n in seen[0].items()}, {v: named["lang"].get(v, mixing.REST) for v in seen[1]}, {v: 0.5 for v in seen[2]}]
    want = brute_rake(share, [{v: x / sum(r.values()) for v, x in r.items()} for r in raw], 40)
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, n_tokens long")
    got = {(r.source, r.lang, r.topic): r for r in mixing.rake(df, named, keep=0.6).collect()}
    assert {c: round(w / share[c], 5) for c, w in want.items()} == {c: round(r.weight, 5) for c, r in got.items()}
    assert abs(sum(r.prob * share[c] for c, r in got.items()) - 0.6) < 1e-4 and max(r.prob for r in got.values()) <= 1


def test_mixture_keeps_columns_of_any_name(spark, odd):
    from pyspark.sql import functions as F

    wide = odd
    for c in ("mix_topic", "mix_tokens", "to_lang", "its_lang", "n_tokens", "topic", "prob", "kept", "row", "weight", "salt", "a.b"):
        wide = wide.withColumn(c, F.lit("mine"))
    kept = mixing.sampled(wide, keep=1.0)
    assert kept.columns == wide.columns and all(set(r[5:]) == {"mine"} for r in kept.collect()) and kept.count() == len(ODD)


def test_urls(spark):
    rows = [
        (1, "http://a.example.com/de/1", None), (2, "http://b.net/x", '<link rel="canonical" href="http://a.example.com/de/1">'), (3, "http://c.net/y", "<meta http-equiv='refresh' content='0; url=http://b.net/x'>"),
        (4, "http://d.com/fr/1", '<link href="http://b.net/x" rel="canonical"/>'), (5, None, "x"), (6, "nope", None), (7, "https://EXAMPLE.org/es/1?x#y", "<p>"), (8, "http://b.net/x#frag", None), (9, "http://z.example.org/en/12", ""), (10, "http://k.org", ""), (10, "http://k.org", ""),
    ]
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    allow, block = "allow", "block"
    assert [(a, c) for a, _, c in got] == [(1, block), (2, block), (3, block), (4, allow), (5, allow), (6, allow), (7, block), (8, block), (9, block), (10, allow), (10, allow)]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_relative_links_of_every_tag(spark):
    link, refresh = '<link rel="canonical" href="{}">'.format, '<meta http-equiv="refresh" content="0; url={}">'.format
    bad = "http://a.example.com/de/1"
    html = {
        "http://n.net/d/old.html": link("new.html"), "http://n.net/d/new.html": link(bad),
        "http://n.net/d/e/f": refresh("../x"), "http://n.net/d/x": refresh(bad),
        "http://n.net/p?id=1": link("?id=2&amp;v=1"), "http://n.net/p?id=2&v=1": link(bad),
        "http://bare.net": link("./q/../y"), "http://bare.net/y": link(bad),
        "http://bare2.net": link("?k"), "http://bare2.net/?k": link(bad),
        "http://up.net/a": link("../../../b/."), "http://up.net/b/": link(bad),
        "http://two.net/1": link("http://safe.net/") + link(bad), "http://two.net/2": refresh("/other") + refresh(bad),
        "http://rel.net/1": f"<link href='{bad}' rel='alternate canonical'>", "http://rel.net/2": f"<link rel=canonical href={bad}>",
        "http://ok.net/1": link("mailto:a@b.c") + link("#top") + link(""), "http://ok.net/2": link("/go?u=" + bad), "http://ok.net/3": f'<link rel="non-canonical" href="{bad}">',
    }
    rows = [(k, u, h) for k, (u, h) in enumerate([*html.items(), (bad, "")])]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {u: got[k] for k, u, _ in rows} == {u: "allow" if "ok.net" in u else "block" for _, u, _ in rows}


@pytest.mark.parametrize("size", [0.2, 1e5, 4e5, 1e15])
def test_knn_by_brute_force(spark, size):
    random.seed(9)
    around = [random.gauss(0, size) for _ in range(6)]
    rows = [(k, [random.gauss(0, size) for _ in range(6)], 0) for k in range(300)] + [(1000 + k, [0.5 * size] * 6, 1) for k in range(200)]
    rows += [(2000 + k, [c + random.gauss(0, 1) for c in around], 1) for k in range(200)]
    rows += [(50_000, None, 0), (50_050, [None] * 6, 0), (50_100, [float("nan")] * 6, 0), (None, [0.1] * 6, 0), (50_150, [0.1] * 9, 0), (100, [0.3 * size] * 6, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "0 AS cell", "1 AS query_id", "2 AS score")
    good = [(r.vec_id, tuple(r.v)) for r in knn._whole(df.select("vec_id", "embedding"), 256).collect() if len(r.v) == 6]
    old, knn.BLOCK = knn.BLOCK, 64
    try:
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(df, pivots=8).collect())
    finally:
        knn.BLOCK = old
    want = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        mine = min(v for i, v in good if i == q)
        s = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in good if i != q)[:5]
        want += [(q, k + 1, i, min(knn.HIGH, max(knn.LOW, -v))) for k, (v, i) in enumerate(s)]
    assert got == want
    assert knn.top_k(df.limit(0)).count() == 0 and knn.top_k(df.filter("vec_id IN (0, 1)")).count() == 1


def test_quality_and_language_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (5, 0), (99, 1), (6, None)], "doc_id long, quality int")
    got = gam.score(extra(odd), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert gam.keep_good(extra(odd), labels).columns == extra(odd).columns
    assert {r.score for r in gam.score(odd, labels.limit(0)).collect()} == {0.5}
    lang = langid.identify(extra(odd)).collect()
    assert len(lang) == len(ODD) and all(r.lang_pred == "und" for r in lang if r.doc_id in (1, 2, 7))
    assert langid.identify(odd.limit(0)).count() == 0


def test_sample_takes_distinct_texts(spark):
    from pyspark.sql import functions as F

    copies = spark.range(340_000).select(F.lit("hot copy").alias("text"), F.lit("aa").alias("lang"))
    empty = spark.range(5_000).select(F.lit("").alias("text"), F.lit("bb").alias("lang"))
    own = spark.range(500).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.explode(F.array(F.lit("aa"), F.lit("bb"))).alias("lang"))
    few = spark.createDataFrame([("one", "cc"), ("one", "cc"), ("two", "cc"), (None, "dd"), ("x", None)], "text string, lang string")
    texts, langs = langid.sample(copies.unionByName(empty).unionByName(own).unionByName(few))
    texts = [t.decode() for t in texts]
    assert {k: langs.count(k) for k in set(langs)} == {"aa": 400, "bb": 400, "cc": 2}
    assert len(set(zip(texts, langs, strict=True))) == len(texts) and langs == sorted(langs)


def test_sample_reads_whole_texts(spark):
    head, tail = "start " * 2000, "sequel " * 2000
    rows = [(f"{head}{k} {tail}", "aa") for k in range(60)]
    pieces, _ = langid.sample(spark.createDataFrame(rows, "text string, lang string"))
    assert all(len(p) == langid.WINDOW for p in pieces)
    assert 20 < sum(b"sequel" in p for p in pieces) < 100 and 20 < sum(b"start" in p for p in pieces)


def brute_verdicts(rows):
    """Pages judged with the standard library's parser and resolver, page by page."""
    from html.parser import HTMLParser
    from urllib.parse import urldefrag, urljoin

    class Tags(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "link" and "canonical" in (a.get("rel") or "").lower().split() and a.get("href"):
                self.found.append(a["href"])
            if tag == "meta" and (a.get("http-equiv") or "").lower() == "refresh" and "url=" in (a.get("content") or ""):
                self.found.append(a["content"].split("url=")[1])

    def name(url):
        rest = urldefrag(url)[0].split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?" if c in rest] or [len(rest)])
        return rest[:cut].lower() + (rest[cut:] if rest[cut:].startswith("/") else "/" + rest[cut:])

    def own(url):
        best = None
        n = name(url)
        host, path = n.split("/", 1)
        for r in url_filter.RULES:
            if (host == r.host or host.endswith("." + r.host)) and ("/" + path.split("?")[0]).startswith(r.path) and (best is None or len(r.name) > len(best.name)):
                best = r
        return best and best.verdict

    up, bad = {}, set()

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for _, url, html in rows:
        t = Tags()
        t.feed(html)
        for h in t.found:
            up[top(name(url))] = top(name(urljoin(url, h)))
            bad |= {urljoin(url, h)} if own(urljoin(url, h)) == "block" else set()
    bad = {top(name(u)) for u in bad | {u for _, u, _ in rows if own(u) == "block"}}
    return {k: own(u) or ("block" if top(name(u)) in bad else "allow") for k, u, _ in rows}


def test_redirects_by_brute_force(spark, monkeypatch):
    random.seed(12)
    hosts = ["a.example.org", "b.net", "c.com", "d.net", "e.net", "F.net"]
    paths = ["/de/1", "/es/2", "/x", "/y/z", "/fr/3", "/", "/y/w", "/en/12"]
    urls = [f"http://{random.choice(hosts)}{random.choice(paths)}" + random.choice(["", "?a=1", "?b=2"]) for _ in range(120)]
    rows = []
    for k, u in enumerate(urls):
        link = random.choice([None, None, random.choice(urls), random.choice(paths), "z", "../x", "?a=1"])
        html = "" if link is None else random.choice(['<link rel="canonical" href="{}">', "<meta http-equiv='refresh' content='0; url={}'>"]).format(link)
        rows.append((k, u, "<html>" + html))
    rows += [(1000 + k, "http://hot.net/", "") for k in range(40)] + [(2000, "http://b.net/q", '<link rel="canonical" href="http://hot.net/">'), (2001, "http://b.net/q", '<link rel="canonical" href="http://c.com/de/9">')]
    want = brute_verdicts(rows)
    assert set(want.values()) == {"allow", "block"} and want[1000] == "block"
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_SHARE", 0)
    df = extra(spark.createDataFrame(rows + [(3000 + k, None, None) for k in range(30)], "page_id long, url string, html string"))
    got = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert {k: v for k, v in got.items() if k < 3000} == want and {v for k, v in got.items() if k >= 3000} == {"allow"}


def test_urls_of_many_pages(spark):
    """Pages of one url that nothing blocks keep their rows, however many there are; so do blocked ones and pages without a url."""
    n = 2 * common.HOT_ROWS
    urls = {"https://a.net/x": (None, "allow"), "https://b.com/de/x": ("com/de/", "block"), None: (None, "allow")}
    rows = [(k * n + i, url, "") for k, url in enumerate(urls) for i in range(n)] + [(3 * n, "https://c.net/y", "")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    expected = [(i, *urls.get(url, (None, "allow"))) for i, url, _ in rows]
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == expected


def test_join_does_not_depend_on_what_is_hot(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, n int")
    right = spark.createDataFrame([("b", "x"), ("c", "y")], "k string, v string")
    for hot in ([], ["a"], ["b"], ["a", "b", "c"]):
        got = common.join_spread(left, right, "k", spark.createDataFrame([(k,) for k in hot], "k string")).select("k", "n", "v").collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == [("a", 1, None), ("a", 2, None), ("b", 3, "x"), (None, 4, None)]


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(sql.ORACLES[name]).df()[list(got.columns)]
    key = list(got.columns)[:3]
    norm = lambda d: d.astype(str).sort_values(key).reset_index(drop=True)
    assert norm(got).equals(norm(want))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = queries.queries()["op10_byte_convnet"](spark, d).filter("held_out").join(lang, "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    labels = spark.read.parquet(f"{d}/labels.parquet")
    q = queries.queries()["op5_pairwise_gam"](spark, d).filter("held_out").join(labels, "doc_id").toPandas()
    assert (q.predicted == q.quality).mean() > 0.93


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    seen = docs
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen = stage(spark, seen, sf_dir)
        if k + 1 < len(names):
            assert seen.columns == docs.columns
            rows = seen.collect()
            seen = spark.createDataFrame(rows, docs.schema)
            sizes.append(len(rows))
            if name == "near_duplicates":
                want = brute_components([(r.doc_id, r.text) for r in rows], 5, 80)
                assert all(c == i for i, (_, c) in want.items())
            if name == "personal_data":
                assert all(not pii.scan(r.text)[0] for r in rows)
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[3] and seen.count() == sizes[-1]
