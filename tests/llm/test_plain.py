"""Operators' local parts against brute force, without Spark."""

import random
import re
import time

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import chunked_bpe, fingerprint, gam, knn, langid, neardup, pii, prefix_tokens

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute_pii(t):
    out = []
    for kind, pattern in pii.BASE_PATTERNS.items():
        for m in re.finditer(pattern, t):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.RANK[s[2]], s[1]))


BITS = ["1.2.3.4", "255.", "4111111111111111", "+49 ", "030-", "a@b", ".c", "@", ".", " ", "1", "-", "(0)", "é", "٣", "\n", "%", "+"]


@given(st.lists(st.sampled_from(BITS), max_size=16).map("".join))
@settings(max_examples=1500, deadline=None)
def test_pii_base_spans(t):
    assert pii.scan(t)[0] == brute_pii(t)


def test_pii_added_spans_and_mask():
    assert pii.mask('mail a.b@c.de, token = "681c09b8e90e7e8c9575180f595f646c" end') == 'mail <EMAIL>, token = "<ACCOUNT>" end'
    assert pii.mask("IBAN: DE89 3704 0044 0532 0130 00.") == "IBAN: <ACCOUNT>."
    assert pii.mask("ssn 123-45-6789 x") == "ssn <ACCOUNT> x"
    assert pii.mask("see postgres://me:pw@host/db now") == "see <ADDRESS> now"
    assert pii.mask("http://plain.example.com/x?y stays") == "http://plain.example.com/x?y stays"
    assert pii.mask(None) is None and pii.mask("") == ""


def test_pii_any_case_and_wide_gaps():
    assert pii.mask("Customer ID:     12345678 x") == "Customer ID:     <ACCOUNT> x"
    assert pii.mask("API Key = abcdefgh12345") == "API Key = <ACCOUNT>" and pii.mask("aCCt #123456-7") == "aCCt #<ACCOUNT>"
    assert pii.mask("HTTPS://me:pw@h/x. MAILTO:joe@x.org.") == "<ADDRESS>. <ADDRESS>."
    assert pii.mask("\u0130 ssn 123-45-6789") == "\u0130 ssn <ACCOUNT>"  # lowering this letter alone would make the text longer
    assert pii.mask("http://a/b@c http://http://u:p@h") == "http://a/b@c http://http://u:p@h"[:13] + "http://<ADDRESS>"


@pytest.mark.parametrize("unit", ["ssn ", "http://", "mailto:", "token=", "token.", "iban ", "iban - ", "acct 12-", "ssh://@", "a@", "+1 ", "1."])
def test_pii_time_grows_with_length(unit):
    for tail in ("", "." * 50_000):
        began = time.process_time()
        pii.scan(unit * 200_000 + tail)
        assert time.process_time() - began < 8


@given(st.text("ab the  ing\n\té漢😀ñ1▁ _", max_size=40))
@settings(max_examples=300, deadline=None)
def test_prefix_counts(t):
    model = prefix_tokens.pieces(PIECES)
    c = prefix_tokens.PrefixCounts(model, t)
    count = lambda s: len(model.model.encode(s))
    assert model.table or not t
    assert c.total == count(t)
    for i in range(len(t) + 1):
        assert c.at(i) == count(t[:i])
    for budget in (0, 1, 3):
        assert count(t[: c.fit(budget)]) <= budget


@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "'re", "'", "1", "é", "漢", "!", "\t", " of", "<|endoftext|>", "<|endof"]), max_size=60).map("".join), st.randoms())
@settings(max_examples=400, deadline=None)
def test_chunked_bpe_is_exact(t, rnd):
    c = chunked_bpe.coder(BPE)
    want = c.library.encode(t, add_special_tokens=False).ids
    data = t.encode()
    cuts = sorted({x for x in (rnd.randint(0, len(data)) for _ in range(4)) if x == len(data) or data[x] & 0xC0 != 0x80} | {0, len(data)})
    known = {k: np.asarray(c.plain(data[cuts[k] : cuts[k + 1]].decode())) for k in range(len(cuts) - 1) if rnd.random() < 0.7}
    assert c.direct(t) == want
    if "<|endoftext|>" not in t and len(data):
        assert c.assemble(data, cuts, known) == want
    assert c.decode(want) == t == c.library.decode(want, skip_special_tokens=False)


def test_chunk_borders_follow_content():
    random.seed(5)
    body = "".join(random.choice("abcdefgh ") for _ in range(6000))
    one, two = ("xyz" + body).encode(), ("some other beginning " + body).encode()
    pieces = lambda d: {d[a:b] for a, b in zip(e, e[1:], strict=False)} if (e := chunked_bpe.borders(d)) else set()
    assert len(pieces(one) & pieces(two)) > len(pieces(one)) / 2
    for d in (b"", b"a", ("é" * 9000).encode()):
        e = chunked_bpe.borders(d)
        assert e[0] == 0 and e[-1] == len(d) and b"".join(d[a:b] for a, b in zip(e, e[1:], strict=False)) == d
        for a in e:
            d[:a].decode()


def test_digests():
    a, b = "The and attion to thanedble the, anea. " * 20, "Zu und. Dieüauß der. Enö, chlichte ie das. " * 20
    x, y = fingerprint.digest(a.encode()), fingerprint.digest(b.encode())
    assert fingerprint.likeness(x, x) == 1.0 and 0 <= fingerprint.likeness(x, y) < 0.7
    assert fingerprint.likeness(x, fingerprint.digest((a[:600] + b[:100]).encode())) > fingerprint.likeness(x, y)
    for t in ("", "a", "ab", "\x00"):
        assert fingerprint.likeness(fingerprint.digest(t.encode()), fingerprint.digest(t.encode())) == 1.0


def test_bayes_bound_keeps_similar_pairs():
    signer = neardup.Signer(85, 7)
    random.seed(2)
    base = [f"w{random.random()}" for _ in range(300)]
    near = base[:]
    near[40] = "other"
    far = base[:150] + [f"v{k}" for k in range(150)]
    s = [neardup.shingles(" ".join(w), 3) for w in (base, near, far)]
    sig = np.stack([signer.signature(x) for x in s])
    i, j = neardup._survivors(sig, sig, 85, 1e-6, True)
    assert (0, 1) in set(zip(i.tolist(), j.tolist(), strict=True)) and (0, 2) not in set(zip(i.tolist(), j.tolist(), strict=True))
    many = np.repeat([[0], [1]], 200, axis=1)
    assert (neardup._overlaps([s[0], s[1]], [s[1], s[2]], many[0], many[1])[:1] == len(np.intersect1d(s[0], s[2]))).all()


def test_shingles_words():
    assert len(neardup.shingles("A b\x0bC d", 3)) == 2
    assert np.array_equal(neardup.shingles("A B", 3), neardup.shingles("a\tb ", 3)) and len(neardup.shingles("a b", 3)) == 1
    assert len(neardup.shingles("a\xa0b", 3)) == 1 and not len(neardup.shingles(" \n", 3)) and not len(neardup.shingles(None, 3))


def test_gam_learns_and_interacts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = gam.fit(x[:2400], y[:2400])
    assert (0, 1) in m.pairs or (1, 0) in m.pairs
    assert ((m.score(x[2400:]) > 0.5) == (y[2400:] > 0.5)).mean() > 0.85
    assert np.allclose(gam.fit(x[:5], np.ones(5)).score(x[:2]), 0.99) and np.allclose(gam.fit(x[:0], y[:0]).score(x[:2]), 0.5)
    assert np.isfinite(gam.describe(None)).all() and np.isfinite(gam.describe("x" * 200_000)).all()


def brute_network(net, text):
    """The network's definition, place by place, on every window of a text."""
    data, total, mass = text.encode(), np.zeros(len(net.labels)), 0
    for a in range(0, len(data), langid.WINDOW):
        part = data[a : a + langid.WINDOW]
        e = net.embed[np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)]
        pooled = []
        for f, bias in zip(net.filters, net.bias, strict=True):
            z = [sum(e[i + k] @ f[k] for k in range(len(f))) + bias for i in range(len(e) - len(f) + 1)]
            pooled.append(np.max(z, axis=0))
        logit = np.maximum(np.concatenate(pooled), 0) @ net.out + net.out_bias
        total += len(part) * (logit - np.log(np.exp(logit).sum()))
        mass += len(part)
    prob = np.exp(total / mass)
    prob /= prob.sum()
    return net.labels[int(prob.argmax())], float(prob.max())


def test_network_by_brute_force():
    random.seed(6)
    make = lambda k: " ".join(random.choice(k) for _ in range(90))
    kinds = {"aa": ["the", "and"], "bb": ["der", "schön"], "cc": ["ño", "que"]}
    net = langid.train([make(w).encode() for w in kinds.values() for _ in range(20)], [k for k in kinds for _ in range(20)])
    texts = [make(w) for w in kinds.values()] + ["x", "the schön " * 60]
    for (label, p), t in zip(langid.Scorer(net).texts(texts), texts, strict=True):
        want, q = brute_network(net, t)
        assert label == want and abs(p - q) < 1e-4


def brute_difference(a, b):
    """Two digests bucket by bucket."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    total = min(48, abs(x[0] - y[0])) + sum(min(12, abs(x[k] - y[k]) // 4) for k in (1, 2))
    for p, q in zip(x[3:], y[3:], strict=True):
        for k in range(4):
            d = abs((p >> 2 * k) % 4 - (q >> 2 * k) % 4)
            total += 6 if d == 3 else d
    return total


def brute_digest(data):
    counts = [0] * 512
    padded = data.ljust(12, b"\0") if data else b""
    for i in range(len(padded) - 11):
        for k, (p, q, r) in enumerate(fingerprint.TRIPLETS):
            h = padded[i + p] | padded[i + q] << 8 | padded[i + r] << 16
            counts[((h ^ h >> 11) * (0x9E3779B1 * (2 * k + 1) % 2**32) % 2**32) >> 23] += 1
    s = sorted(counts)
    q1, q2, q3 = s[127], s[255], s[383]
    out = bytearray([min(255, int(12 * np.log2(len(data) + 1))), *((100 * q // q3) % 256 if q3 else 0 for q in (q1, q2))])
    for k in range(0, 512, 4):
        out.append(sum(((counts[k + m] > q1) + (counts[k + m] > q2) + (counts[k + m] > q3)) << 2 * m for m in range(4)))
    return out.hex()


@given(st.lists(st.text("ab cdé漢\n", max_size=60), min_size=2, max_size=2))
@settings(max_examples=60, deadline=None)
def test_digests_by_brute_force(texts):
    a, b = (fingerprint.digest(t.encode()) for t in texts)
    assert [a, b] == [brute_digest(t.encode()) for t in texts]
    assert fingerprint.difference(a, b) == brute_difference(a, b)
    assert fingerprint.likeness(a, b) == (1.0 if a == b else max(0.0, 1 - brute_difference(a, b) / (512 * 2 + 24 + 48)))


def test_language_network():
    random.seed(1)
    words = {"aa": ["the", "and", "ing", "tion"], "bb": ["der", "und", "schaft", "keit"], "cc": ["los", "ción", "ñar", "que"]}
    make = lambda k: " ".join(random.choice(words[k]) for _ in range(60))
    net = langid.train([make(k).encode() for k in words for _ in range(60)], [k for k in words for _ in range(60)])
    s = langid.Scorer(net)
    got = s.texts([make("aa"), make("bb"), make("cc"), None, "123 ...", ""])
    assert [g[0] for g in got] == ["aa", "bb", "cc", "und", "und", "und"]
    assert langid.train([], []) is None
    assert langid.Scorer(langid.train([b"abc"], ["xx"])).texts(["q"])[0] == ("xx", 1.0)


@pytest.mark.parametrize(("size", "exact"), [(50, True), (2**30, False), (2**58, False)])
def test_best_scores_are_exact(size, exact):
    rng = np.random.default_rng(3)
    x = rng.integers(-size, size, (300, 4))
    x[100:200] = x[0]
    x[200:230] += rng.integers(0, 2, (30, 4))
    ids = rng.permutation(300)
    q, own = x[:20], ids[:20]
    rows, found, scores, keys = knn._best(q, x, ids, own, 5, exact)
    got = sorted(zip(rows, found, scores, strict=True))
    want = []
    for r in range(20):
        s = sorted((-sum(a * b for a, b in zip(q[r].tolist(), x[c].tolist(), strict=True)), int(ids[c])) for c in range(300) if ids[c] != own[r])[:5]
        want += [(r, i, min(knn.HIGH, max(knn.LOW, -v))) for v, i in s]
    assert got == sorted(want) and (keys[0] is None) == exact


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_every_code_point_is_cut_alike(name):
    c = chunked_bpe.coder(P.path(name))
    for lo in range(0, 0x30000, 4096):
        cs = [chr(x) for x in range(lo, lo + 4096) if not 0xD800 <= x < 0xE000]
        ts = [f"a{x}b {x}1{x} {x}{x}  {x}." for x in cs]
        if ts:
            assert [e.ids for e in c.library.encode_batch_fast(ts, add_special_tokens=False)] == [c.plain(t) for t in ts]


def test_sentencepiece_agrees_on_long_text():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    random.seed(8)
    solid = "".join(random.choice("ABCabc123+/=漢字é") for _ in range(60_000))
    for t in ("thererhendtion " * 3000, solid, " " * 5000 + "a" * 70, "xyz" * 100 + " " + "xyz" * 20):
        c = prefix_tokens.PrefixCounts(prefix_tokens.pieces(PIECES), t)
        assert c.total == len(model.encode(t)) and all(len(k) <= prefix_tokens.LONGEST for k in c.pieces.table)


def test_prefix_tables_at_every_code_point():
    p = prefix_tokens.pieces(PIECES)
    for lo in range(0, 0x30000, 512):
        cs = [chr(x) for x in range(lo, lo + 512) if not 0xD800 <= x < 0xE000]
        for t in ("".join(cs), " ".join(cs), "a".join(cs)):
            assert prefix_tokens.PrefixCounts(p, t).total == len(p.model.encode(t))


def test_small_memos_give_the_same(monkeypatch):
    monkeypatch.setattr(prefix_tokens, "MEMO", 500)
    monkeypatch.setattr(prefix_tokens, "PAIRS", 3)
    p = prefix_tokens.Pieces(PIECES)
    for t in ("the andor ing tion  the", "schaft und die leute", "the andor" * 9):
        assert prefix_tokens.PrefixCounts(p, t).total == len(p.model.encode(t))


def test_words_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(neardup, "MEMO", 2000)
    words = neardup._Words()
    for k in range(500):
        words[f"word{k}".encode()], words[b"x" * 100_000]
    assert len(words) < 30 and all(len(w) <= neardup.LONGEST for w in words)
