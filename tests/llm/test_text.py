import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import url_filter
from factloom.llm.bpe import Codec, bpe_decode, bpe_digests, bpe_encode
from factloom.llm.html_extract import extract, importances, main_blocks, parse
from factloom.llm.licenses import BASE, BSD_NAMES, WORD_BYTES, WORDINGS, Automaton, Scanner, license_scan
from factloom.llm.lm_score import Filter, levels, lm_scores, ngram_tables
from factloom.llm.quality import Machine, features, fit, keep_good, quality_scores
from factloom.llm.url_filter import url_verdicts


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_whole_tables(docs, texts, odd, odd_rows, none, library):
    for frame, rows in ((docs, list(texts.items())), (odd, [(r[0], r[1]) for r in odd_rows])):
        want = []
        for i, t in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(frame).collect()) == sorted(want)
    back = {r.doc_id: r.text for r in bpe_decode(bpe_encode(docs)).collect()}
    assert back == texts and bpe_digests(none).count() == 0


ALPHABET = ["a", "b", " ", "  ", "\n", "\r\n", "'s", "'", "é", "1", "23", ".", "!!", "\xa0", "中", "\t", "<|endoftext|>", "🙂", "\x85", "the", "The", "\u3000", "ß", "|", "×"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join), max_size=6))
def test_bpe_any_text(library, rows):
    c = Codec(chunk_bits=2)
    for encode in (c.encode_units, c.encode_chunks):
        ids, ends = encode(pa.array(rows, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in rows]


def test_licences(docs, texts, odd, odd_rows, none):
    def expected(text):
        words = (text or "").encode().translate(WORD_BYTES).split()
        at = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
        return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))

    for frame, rows in ((docs, list(texts.items())), (odd, [(r[0], r[1]) for r in odd_rows])):
        got = license_scan(frame).collect()
        assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(str((i, *expected(t))) for i, t in rows)
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_scan(none).count() == 0
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in odd_rows[11][1])
    assert [w.decode() for w in odd_rows[11][1].encode().translate(WORD_BYTES).split()] == word.findall(lower)


def test_matching_statistics():
    rng = np.random.default_rng(6)
    wordings = [rng.integers(0, 4, 12).tolist() for _ in range(5)]
    text = rng.integers(0, 5, 400).tolist()
    parts = {tuple(w[i:j]) for w in wordings for i in range(12) for j in range(i + 1, 13)}
    auto = Automaton(wordings)
    for i, (state, length) in enumerate(auto.statistics(text)):
        want = max((n for n in range(1, 13) if n <= i + 1 and tuple(text[i + 1 - n : i + 1]) in parts), default=0)
        assert length == want
        for w, end in auto.places[state]:
            assert wordings[w][end - length : end] == text[i + 1 - length : i + 1]


def test_licence_wordings():
    scan = lambda t: [x.to_pylist()[0] for x in Scanner().scan(pa.array([t]))]
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    assert scan(mit)[5] == "mit" and scan(mit)[6] == 1.0
    assert scan(mit.replace("obtaining a copy", "who gets one"))[5] == "mit"  # chained over a gap
    assert scan("This work is licensed under the GNU General Public License, version 3.")[5] == "gpl"
    assert scan("the license of the software is free to use")[5] == ""


def plain_scan(text, scanner, min_match=3):
    """Longest common runs of text and each wording by loops: for each wording the words that runs of min_match words or more cover."""
    words = (text or "").encode().translate(WORD_BYTES).split()
    out = {}
    for label, base, wording in zip(scanner.labels, scanner.is_base, scanner.wordings, strict=True):
        if base:
            continue
        names = {i: w for w, i in scanner.vocab.items()}
        own = [names[i] for i in wording]
        covered = set()
        for i in range(len(words)):
            for j in range(len(own)):
                n = 0
                while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                    n += 1
                if n >= min_match:
                    covered |= set(range(j, j + n))
        out[label] = max(out.get(label, 0), len(covered) / len(own))
    return out


def test_whole_licences():
    """Whole texts, cut and edited: the label is found where a plain comparison finds most of a wording, and none where it finds little."""
    scanner = Scanner()
    rng = np.random.default_rng(15)
    for text, label in WORDINGS[-9:]:
        words = text.split()
        for edits in (0, 3):
            own = list(words)
            for at in rng.choice(len(own), edits, replace=False):
                own[at] = "qqq"
            whole = "Foo bar. " + " ".join(own) + " Baz"
            got = [x.to_pylist()[0] for x in scanner.scan(pa.array([whole]))]
            assert label in got[5].split(",") and got[6] >= 0.6
            cover = plain_scan(whole, scanner)
            assert all(s["cover"] <= cover[s["label"]] + 1e-9 for s in got[7])
            assert {k for k, v in cover.items() if v >= 0.95} <= set(got[5].split(","))
        for start in (0, 7):  # a sentence that goes on in its whole text
            scan = scanner.scan(pa.array([" ".join(words[start : start + 40])]))[5].to_pylist()[0]
            if label in ("mit", "bsd", "gpl", "isc", "apache-2") and text != BSD_NAMES:
                assert label in scan.split(","), (text, start)
        part = " ".join(words[: len(words) // 4])
        got = [x.to_pylist()[0] for x in scanner.scan(pa.array([part]))]
        assert set(filter(None, got[5].split(","))) <= {k for k, v in plain_scan(part, scanner).items() if v >= 0.6}


def test_memo_is_bounded_in_bytes():
    from factloom.llm.bpe import Memo

    memo = Memo(lambda texts: [[1] * len(t) for t in texts], 1000, max_bytes=1000)
    for i in range(50):
        pool, at, size = memo([f"{i}".rjust(100).encode(), b"a"])
        assert size.tolist() == [100, 1] and len(memo.index) <= 5 and memo.bytes <= 1000 + 600


def test_urls(spark):
    rows = [
        ("http://a.com/x", "com/", "allow"),
        ("https://WWW.Example.com/en/1", "www.example.com/en/", "allow"),
        ("https://b.example.com/en/1?q", "example.com/en/", "block"),
        ("https://b.example.com/EN/1", "com/", "allow"),
        ("ftp://net/es/", "net/es/", "block"),
        ("http://x.net/fr/?a", "net/fr/", "block"),
        ("http://x.net/fr", None, "allow"),
        ("http://xcom/", None, "allow"),
        ("http://a.com?x=/", None, "allow"),
        ("http://a.com#/", None, "allow"),
        ("a.com/x", None, "allow"),
        (None, None, "allow"),
        ("", None, "allow"),
        ("x://y://z/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, None, "h", "r") for i, (u, _, _) in enumerate(rows)] + [(99, rows[0][0], "", "h", "r")], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: r for r in url_verdicts(pages).collect()}
    assert [(u, got[i].rule, got[i].verdict) for i, (u, _, _) in enumerate(rows)] == rows
    assert (got[8].host, got[8].path, got[2].host, got[2].path, got[10].host, got[13].host, got[13].path) == ("a.com", "", "b.example.com", "/en/1", "", "y:", "//z/")
    assert url_verdicts(pages.limit(0)).count() == 0


def plain_verdicts(pages, rules, seeds, damping=0.85, steps=200, threshold=0.5):
    """verdict of each url by loops over dicts; pages: (id, url, hosts and paths it links to)."""

    def split(url):
        host, _, rest = url.partition("://")[2].partition("/")
        return host.lower(), "/" + rest

    def under(host, h):
        return host == h or host.endswith("." + h)

    def rule(host, path):
        fits = [r for r in rules if under(host, r[0]) and path.startswith(r[1])]
        return max(fits, key=lambda r: len(r[0] + r[1]), default=(None, None, None))[2]

    def site(url):
        host, path = split(url)
        return host, rule(host, path)

    links = {}
    nodes = {site(u) for _, u, _ in pages}
    for _, u, to in pages:
        for x in to:
            a, b = site(u), site("http://" + x)
            if a[0] != b[0]:
                nodes |= {a, b}
                links.setdefault(a, {}).setdefault(b, 0)
                links[a][b] += 1
    named = lambda host: max(((len(h), v == "block", v) for h, v in seeds if under(host, h)), default=(0, 0, None))[2]
    fixed = {n: n[1] or named(n[0]) for n in nodes}
    seed = {n: float(fixed[n] == "allow") for n in nodes}
    trust, distrust = dict(seed), {n: float(fixed[n] == "block") for n in nodes}
    for _ in range(steps):
        lost = sum(r for n, r in trust.items() if n not in links) / (sum(seed.values()) or 1)
        got = dict.fromkeys(nodes, 0.0)
        for a, to in links.items():
            for b, n in to.items():
                got[b] += trust[a] * n / sum(to.values())
        trust = {n: (0.15 + damping * lost) * seed[n] + damping * got[n] for n in nodes}
        distrust = {n: distrust[n] if fixed[n] or n not in links else damping * sum(distrust[b] * k for b, k in links[n].items()) / sum(links[n].values()) for n in nodes}
    return {i: fixed[site(u)] or ("block" if threshold <= distrust[site(u)] > trust[site(u)] else "allow") for i, u, _ in pages}, {i: (trust[site(u)], distrust[site(u)]) for i, u, _ in pages}


def as_pages(spark, pages):
    html = lambda to: "".join(f'<a href="http://{x}">x</a><a href="/own">y</a>' for x in to)
    return spark.createDataFrame([(i, u, html(to)) for i, u, to in pages], "page_id long, url string, html string")


def test_link_graph(spark):
    """A blocked host that others link to, its link farm, and hosts that only touch it."""
    spam = "spam.org/p"
    pages = [
        (1, "http://www.spam.org/", ["half.org/"]),
        *((10 + i, f"http://farm{i}.org/", [spam]) for i in range(5)),
        (20, "http://behind.org/", [f"farm{i}.org/" for i in range(5)]),
        (21, "http://half.org/", [spam, *["fine.org/"] * 4]),
        (22, "http://fine.org/", ["half.org/"]),
        (23, "http://a.org/", [spam, "b.org/"]),
        (24, "http://b.org/", ["a.org/", spam]),
        *((30 + i, f"http://good{i}.com/", [spam]) for i in range(9)),  # a popular blocked host has trusted links
        (50, "http://x.net/fr/1", []),  # a rule on a path says nothing about the host
        (51, "http://x.net/de/1", []),
        (52, "http://to.org/1", ["x.net/fr/2"]),
        (53, "http://notspam.org/", []),
        (54, "http://ok.spam.org/", []),
    ]
    seeds = [("spam.org", "block"), ("OK.spam.org", "allow")]
    got = {r.page_id: r for r in url_verdicts(as_pages(spark, pages), seeds=spark.createDataFrame(seeds, "host string, verdict string")).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, *range(10, 15), 20, 23, 24, 50, 52}
    want, ranks = plain_verdicts(pages, url_filter.RULES, [(h.lower(), v) for h, v in seeds])
    assert {i: r.verdict for i, r in got.items()} == want
    assert all(abs(got[i].trust - t) < 2e-2 and abs(got[i].distrust - d) < 1e-2 for i, (t, d) in ranks.items())


def test_random_link_graph(spark):
    rng = np.random.default_rng(12)
    hosts = [f"h{i}.org" for i in range(30)] + [f"c{i}.com" for i in range(4)] + [f"n{i}.net" for i in range(10)]
    urls = [f"{h}/{p}/" for h in hosts for p in ("fr", "de")]
    pages = [(i, "http://" + u, [urls[j] for j in rng.choice(len(urls), rng.integers(0, 4))]) for i, u in enumerate(urls)]
    got = {r.page_id: r for r in url_verdicts(as_pages(spark, pages), tolerance=1e-4, threshold=0.2).collect()}
    want, ranks = plain_verdicts(pages, url_filter.RULES, [], threshold=0.2)
    assert {i: r.verdict for i, r in got.items()} == want and len({v for v in want.values()}) == 2
    assert all(abs(got[i].trust - t) < 2e-3 and abs(got[i].distrust - d) < 1e-3 for i, (t, d) in ranks.items())
    assert any(v == "block" and not urls[i].endswith("fr/") for i, v in want.items())


PAGE = """<html><head><title>T &amp; x</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head  line</h1><p>One &lt;b&gt; <b>two<br>three<p>Four<script>var x="</p>"</script> five&nbsp;six</p>
<form><p>mail</p></form><section class=comments><p>nice post</p></section></article><aside>more</aside><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "Head line\n\nOne <b> two three\n\nFour five six"
    rows = [(1, "http://a.org/1", PAGE), (2, None, PAGE), (3, "http://a.org/2", None), (4, "x", ""), (5, "http://a.org/3", "<p>plain"), (5, "http://a.org/3", "<p>plain"), (6, "http://a.org/4", "<nav>only</nav>"), (None, None, "a" * 100_000)]
    frame = spark.createDataFrame([(*r, "h", "t", 1) for r in rows], "page_id long, url string, html string, host string, text string, n_chars int").repartition(2)
    got = extract(frame).collect()
    expect = [(1, want), (2, want), (3, ""), (4, ""), (5, "plain"), (5, "plain"), (6, ""), (None, "a" * 100_000)]
    assert sorted(map(str, ((r.page_id, r.text) for r in got))) == sorted(map(str, expect))
    assert all(r.n_chars == len(r.text) for r in got) and extract(frame.limit(0)).count() == 0


def test_style_tree_removes_what_a_site_repeats(spark):
    """Neutral names: only the tree tells boilerplate from stories. A host of one page shows nothing."""
    page = lambda i: f"<div class=x1><p>All rights of the publisher</p><p>Call us</p></div><div class=story><p>Story {i} begins</p><p>Good day</p><p>and {i * 7} ends</p></div><div class=x2>Visit {'us' if i % 9 else i}</div>"
    pages = [(i, f"http://site.org/{i}", page(i)) for i in range(30)] + [(100, "http://other.org/", "<div class=x1><p>All rights of the publisher</p></div>")]
    pages += [(200 + i, f"http://menu.org/{i}", f"<nav>n{i}</nav><div class=menu>m{i}</div><p>p{i}</p>") for i in range(30)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {i: f"Story {i} begins\n\nand {i * 7} ends" for i in range(30)} | {100: "All rights of the publisher"}
    got = {r.page_id: r.text for r in extract(frame).collect()}
    assert got == want | {200 + i: f"p{i}" for i in range(30)}
    alone = {r.page_id: r.text for r in extract(frame, markup=False).collect()}
    assert alone == want | {200 + i: f"n{i}\n\nm{i}\n\np{i}" for i in range(30)}


def test_importance_against_plain_sums(spark):
    """Every importance equals that of loops over the pages of a host."""
    rng = np.random.default_rng(7)
    pages = [[(f"n{j}", f"t{rng.integers(0, 3 + 40 * (j % 3 == 0))}", f"s{rng.integers(0, 3)}") for j in rng.choice(6, 3, replace=False)] for _ in range(40)]
    rows = [(zlib.crc32(n.encode()), zlib.crc32((n + t).encode()), zlib.crc32(s.encode()), 3) for p in pages for n, t, s in p]
    got = {(r.node, r.mark): r.importance for r in importances(spark.createDataFrame(rows, "node long, mark long, shape long, flag int"), 0.9, 4.0).collect()}
    for j in range(6):
        own = [(t, s) for p in pages for n, t, s in p if n == f"n{j}"]
        if not own:
            continue
        m, base = len(own), np.log(len(own) + 4)
        n_text, n_shape = ({x: sum(o[k] == x for o in own) for x in {o[k] for o in own}} for k in (0, 1))
        entropy = -sum(n / m * np.log(n / (m + 4)) for n in n_shape.values()) / base
        content = {t: 1 - np.log(n) / base for t, n in n_text.items()}
        whole = 0.1 * entropy + 0.9 * np.mean([content[t] for t, _ in own])
        for t, c in content.items():
            key = f"n{j}"
            assert abs(got[zlib.crc32(key.encode()), zlib.crc32((key + t).encode())] - min(whole, 0.1 * entropy + 0.9 * c)) < 1e-9


def test_doubtful_names_in_articles(spark):
    art = lambda i: f"<article><h1>H{i}</h1><div class=related-work>Earlier work {i}</div><div class='share-price'>Up {i}</div><math>x{i}</math><div class=share-with>Tell a friend</div><section class='comments-list'>Nice {i}</section><div class=ad-slot>Buy</div><svg><title>z</title></svg><button>Go</button></article>"
    frame = spark.createDataFrame([(i, f"http://a.org/{i}", art(i)) for i in range(20)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(frame).collect()} == {i: f"H{i}\n\nEarlier work {i}\n\nUp {i}\n\nx{i}" for i in range(20)}


def test_deep_and_unclosed_markup(spark):
    deep = "<div>" * 50_000 + "core" + "</div>" * 50_000
    unclosed = "<b>" * 20_000 + "bold" + "</i></p>" * 20_000
    rows = [(1, deep), (2, unclosed), (3, "<p>" * 20_000 + "x"), (4, "<table><tr><td>" * 5_000 + "cell"), *((10 + i, f"<div><p>same words here</p><p>own {i}</p></div>") for i in range(20))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([(i, "http://d.org/", h) for i, h in rows], "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 12)] == ["core", "bold", "x", "cell", "own 2"]


def test_articles_of_whole_table(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("<p>|</p>|</?h1>", inner))
        assert r.text == "\n\n".join(filter(None, parts))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/pbdiv=\"' !-&;ax", max_size=80))
def test_html_never_fails(source):
    assert all(isinstance(b, str) for b in main_blocks([b[1:] for b in parse(source).blocks]))


def held_out(i, m, r):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m == r


def test_quality(spark, sf, docs, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    machine = fit(docs, labels)
    got = {r.doc_id: r for r in quality_scores(docs, machine).collect()}
    assert len(got) == docs.count() and all(r.held_out == held_out(i, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = [got[i].predicted == q for i, q in truth.items() if got[i].held_out]
    assert np.mean(right) > 0.9
    assert quality_scores(odd, machine).count() == 15 and quality_scores(none, machine).count() == 0
    assert keep_good(docs, machine).columns == docs.columns and keep_good(docs, machine).count() == sum(r.predicted for r in got.values())
    assert fit(docs, labels.limit(0)).linear.any() == False  # noqa: E712


def test_sum_of_squares_identity():
    rng = np.random.default_rng(8)
    m = Machine(64, rng.normal(size=64 + 12 * 14 + 1), rng.normal(size=(64 + 12 * 14 + 1, 3)))
    rows, columns, values = features(pa.array(["A few words, a few!", "", None, "x | y | 12"]), 64)
    got = m.margin(4, rows, columns, values)
    for d in range(4):
        x = [(c, v) for r, c, v in zip(rows, columns, values, strict=True) if r == d]
        want = sum(m.linear[c] * v for c, v in x) + sum(m.factors[x[i][0]] @ m.factors[x[j][0]] * x[i][1] * x[j][1] for i in range(len(x)) for j in range(i))
        assert abs(got[d] - want) < 1e-9


def test_language_model(docs, texts, odd, odd_rows, none):
    for frame, rows, head in ((docs, list(texts.items()), 1 << 20), (docs, list(texts.items()), 50), (odd, [(r[0], r[1]) for r in odd_rows], 2)):
        count: dict = {}
        for i, t in rows:
            if not held_out(i, 7, 2):
                for w in [*(t or "").encode().lower().split(), None]:
                    count[w] = count.get(w, 0) + 1
        n, v = sum(count.values()), len(count)
        want = []
        for i, t in rows:
            ws = [*(t or "").encode().lower().split(), None]
            want.append((str(i), held_out(i, 7, 2), len(ws), sum(w in count for w in ws), n, round(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws), 5)))
        got = lm_scores(frame, filter_bits=24, head=head).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
        assert all(r.score <= 0 and np.isfinite(r.score) for r in got)
    assert lm_scores(none, filter_bits=16).count() == 0


def test_model_beats_base(docs):
    got = [r for r in lm_scores(docs, filter_bits=26).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_filters_grow_with_their_ngrams():
    rng = np.random.default_rng(9)
    for n in (300, 3_000, 300_000):
        keys = np.unique(rng.integers(0, 1 << 32, 2 * n, np.uint32))
        rng.shuffle(keys)
        counts = rng.zipf(1.8, n).clip(max=100_000)
        f = Filter.made(keys[:n], counts, 2, 0.01)
        assert (f.level(keys[:n]) >= levels(counts)).all()
        assert (f.level(keys[n:]) > 0).mean() < 0.025 and (f.level(keys[:n]) > levels(counts)).mean() < 0.025


def test_share_of_bits_is_the_same_at_every_size(docs):
    shares, sizes = [], []
    for part in (docs.where("doc_id % 20 = 0"), docs):
        images = [np.frombuffer(r.image, np.uint8) for r in ngram_tables(part, 6, 2, 0.01, None).where("image is not null").collect()]
        sizes.append(sum(map(len, images)))
        shares.append(sum(int(np.unpackbits(x).sum()) for x in images) / (8 * sizes[-1]))
    assert sizes[1] > 2 * sizes[0] and all(0.08 < x < 0.11 for x in shares)


def test_probes_without_collisions_give_the_quantised_counts():
    rng = np.random.default_rng(14)
    keys = rng.choice(1 << 32, 4000, replace=False).astype(np.uint32)
    counts = rng.zipf(1.7, 4000).clip(max=1 << 20)
    f = Filter.made(keys[:3000], counts[:3000], 2, 0.01, size=1 << 26)
    assert (f.level(keys[:3000]) == [int(c).bit_length() for c in counts[:3000]]).all() and (f.level(keys[3000:]) == 0).all()


def test_scores_by_plain_counts_on_filters_without_collisions(docs, texts, odd, odd_rows):
    """Every score equals that of a plain model over dicts whose counts are quantised alike."""
    for frame, rows in ((docs, list(texts.items())), (odd, [(r[0], r[1]) for r in odd_rows])):
        split = [(i, [b"", *(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
        one, two = {}, {}
        for i, ws in split:
            if not held_out(i, 7, 2):
                for v, w in zip(ws, ws[1:]):
                    one[w] = one.get(w, 0) + 1
                    two[v, w] = two.get((v, w), 0) + 1
        floor = sum(one.values()) + len(one) + 1
        mean = lambda c: (3 * 2.0 ** (int(c).bit_length() - 1) - 1) / 2 if c else 0.0
        c1 = lambda w: mean(one.get(w or b"\n", 0))
        want = sorted((str(i), round(sum(np.log10(min(1.0, (min(mean(two.get((v, w), 0)), c1(v), c1(w)) + 20 * (c1(w) + 1) / floor) / (c1(v) + 20))) for v, w in zip(ws, ws[1:])), 4)) for i, ws in split)
        got = sorted((str(r.doc_id), round(r.score, 4)) for r in lm_scores(frame, false_hits=1e-7).collect())
        off = [(g, w) for g, w in zip(got, want, strict=True) if g[0] != w[0] or abs(g[1] - w[1]) > 2e-4]
        assert len(off) <= 0.01 * len(want)  # the rare false hit


def test_scores_with_grown_filters_are_those_of_exact_counts(docs, texts):
    split = {i: [b"", *(t or "").encode().lower().split(), b"\n"] for i, t in texts.items()}
    one, two = {}, {}
    for i, ws in split.items():
        if not held_out(i, 7, 2):
            for v, w in zip(ws, ws[1:]):
                one[w] = one.get(w, 0) + 1
                two[v, w] = two.get((v, w), 0) + 1
    floor = sum(one.values()) + len(one) + 1
    mean = lambda c: (3 * 2.0 ** (int(c).bit_length() - 1) - 1) / 2 if c else 0.0
    c1 = lambda w: mean(one.get(w or b"\n", 0))
    off = n = 0
    for r in lm_scores(docs).collect():
        ws = split[r.doc_id]
        want = sum(np.log10(min(1.0, (min(mean(two.get((v, w), 0)), c1(v), c1(w)) + 20 * (c1(w) + 1) / floor) / (c1(v) + 20))) for v, w in zip(ws, ws[1:]))
        off, n = off + abs(r.score - want), n + r.n_tokens
    assert off / n < 0.01


def test_copied_articles_keep_their_text(spark):
    body = "<p>The same story</p><p>in every copy</p>"
    page = lambda i: f"<div class=x1><p>All rights of the publisher</p></div><article><h1>Title {i}</h1>{body}</article><div class=x2><p>Call us</p></div>"
    frame = spark.createDataFrame([(i, f"http://copies.org/{i}", page(i)) for i in range(30)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(frame).collect()} == {i: f"Title {i}\n\nThe same story\n\nin every copy" for i in range(30)}


def test_pages_are_the_same_whether_places_are_broadcast_or_shuffled(spark):
    """Many chunks, with branches that go in each; the join by broadcast and by shuffle gives the same pages."""
    page = lambda i: f"<div class=x1><p>All rights of the publisher</p></div><div class=story><p>Story {i} begins</p></div>"
    rows = [(i, f"http://site.org/{i}", page(i)) for i in range(60)] + [(60, None, None), (60, None, ""), (None, "http://site.org/x", page(61))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = sorted([(str(i), f"Story {i} begins") for i in range(60)] + [("60", ""), ("60", ""), ("None", "Story 61 begins")])
    for limit in ("10MB", "-1"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            assert sorted((str(r.page_id), r.text) for r in extract(frame, chunk_bytes=300).collect()) == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
