"""Each operator against a brute-force version, and on awkward rows."""

import hashlib
import random
import re

import duckdb
import pytest

pytest.importorskip("ripplegraph.llm")

from ripplegraph.llm import bpe, decontaminate, html_extract, licenses, line_dedup, quality, simhash, token_count, toxicity, url_filter  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts():
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tied, repeated and very long texts, a null id, and columns whose names the operators use."""
    base = "The quick brown fox jumps over the lazy dog near the old river bank today. "
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, base), (4, base), (5, base), (6, "é" * 10 + " ünï 中文 \x00 <|endoftext|> x"), (7, base * 3000), (None, "one two"), (8, "x" * 200_000)]
    return spark.createDataFrame([(i, t, "en", "a", 1, "b", 2.0) for i, t in rows], "doc_id bigint, text string, lang string, hash string, fp int, class_id string, n_tokens double")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# -- 1


def brute_fingerprint(text):
    import xxhash

    w = SPACE.findall(lower(text))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(texts):
    for t in [*texts[:60], None, "", " ", "a", "a b c d", "A b\tc\nd  e É"]:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_every_pair_within_four_bits_shares_a_key():
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            b[k] ^= np.uint64(1 << int(bit))
    keys = []
    for x in (a, b):
        row, key, _ = simhash.band_keys(x)
        found = {}
        for r, q in zip(row.tolist(), key.tolist(), strict=True):
            found.setdefault(r, set()).add(q)
        keys.append(found)
    assert all(keys[0][k] & keys[1][k] for k in range(len(a)))


def test_links_are_those_of_brute_force(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(25)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(12)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    got = [(r.a, r.b) for r in simhash.links(df).collect()]
    ordered = sorted(map(signed, fps))
    want = {(a, b) for k, a in enumerate(ordered) for b in ordered[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert set(got) == want
    assert len(got) < 4 * len(want) + 10


def test_components_are_those_of_brute_force(spark, texts):
    """component_id of the documents and of copies of them with some words changed."""
    rng = random.Random(8)
    changed = []
    for t in texts:
        words = t.split(" ")
        for _ in range(2):
            w = list(words)
            w[rng.randrange(len(w))] = "zebra"
            changed.append(" ".join(w))
    every = [*texts, *changed]
    fps = [simhash.fingerprint(t.encode()) for t in every]
    label = list(range(len(every)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for j in range(len(every)):
        for k in range(j):
            if (fps[j] ^ fps[k]).bit_count() <= 4 and root(j) != root(k):
                a, b = sorted((root(j), root(k)))
                label[b] = a
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(every)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: root(k) for k in range(len(every))}
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{f:016x}" for k, f in enumerate(fps)}


def test_a_link_is_said_by_few_keys(spark):
    """Keys are long: unlike fingerprints seldom share one, and a pair of fingerprints is joined a few times at most."""
    import numpy as np

    rng = np.random.default_rng(9)
    for n, most in ((2000, 0.02), (8000, 0.08)):
        fps = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        row, key, _ = simhash.band_keys(fps)
        shared = len(key) - len(np.unique(key))
        assert shared < most * n  # candidates grow with the square of n over 2^32 and more


def test_near_duplicates_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10 and simhash.near_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[2].fingerprint == "0" * 16
    assert by[4].component_id == by[5].component_id == 4
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 6, None}
    assert not {2, 3, 5} & {r.doc_id for r in kept.collect()}


# -- 2


def brute_base(text):
    words = SPACE.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        dup += bool(SPACE.search(line)) and line in seen
        seen.add(line)
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    marked = {p for ks in windows.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


def test_base_measures(texts):
    for t in [*texts, None, "", "a\n\na\nb\na", "a b c d e f g h a b c d e f g h", "x " * 40]:
        assert quality.base_measures(None if t is None else t.encode()) == brute_base(t)


def test_js_distance():
    import numpy as np

    refs = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    d = quality.js_distance(np.array([2, 2, 0]), refs)
    assert d[0] == 0 and abs(d[1] - 1) < 1e-12


def test_quality_odd_rows(odd, empty):
    rows = {r.doc_id: r for r in quality.judge_quality(odd).collect()}
    assert rows[1].base_failed and not rows[1].kept and rows[1].n_words == 0 and rows[1].char_distance is None
    assert rows[7].n_words == 45000 and rows[7].base_failed
    assert quality.judge_quality(empty).count() == 0


def test_quality_keeps_prose_and_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judge_quality(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


def test_quality_of_rare_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeioukstrnlmz") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    rare = [(-1, prose(100), "pl"), (-2, prose(100), None), *((-10 - k, prose(100), "it") for k in range(60))]
    rows = {r.doc_id: r for r in quality.judge_quality(docs.union(spark.createDataFrame(rare, docs.schema))).where("doc_id < 0").collect()}
    assert all(rows[d].kept and rows[d].char_distance is None and rows[d].word_distance is None for d in (-1, -2))
    assert all(rows[-10 - k].kept and rows[-10 - k].word_distance < 0.2 for k in range(60))
    # the verdict on a language does not hang on the size of the others
    assert "it" in quality.fit_references(docs.union(docs).union(docs).union(docs).union(spark.createDataFrame(rare, docs.schema)))


# -- 3


def test_url_rules_and_terms(spark):
    judge = url_filter.UrlJudge(url_filter.UrlRules()).judge
    assert judge("http://Shop.Example.com/en/x?y")[:4] == ("shop.example.com", "/en/x", "example.com/en/", "block")
    assert judge("http://www.example.com/en/")[2:4] == ("www.example.com/en/", "allow")
    assert judge("http://a.net/fr/1")[3] == "block" and judge("http://a.net/de/1")[2:4] == (None, "allow")
    assert judge("http://xcom/")[2] is None and judge("http://com/")[2] == "com/"
    assert judge("http://a.org/PORN/1")[3] == "block" and judge("http://a.org/popcorn-pornography")[3] == "allow"
    assert judge("http://a.org/sex-sex")[3:] == ("allow", 0, 1) and judge("http://a.org/sex_cam")[3:] == ("block", 0, 2)
    for u in (None, "", "no scheme", "://", "http://", "http://?x"):
        assert judge(u)[:3] == ("", "", None)
    df = spark.createDataFrame([(1, None, "h"), (1, "http://a.com", "h")], "page_id bigint, url string, host string")
    assert [r.path for r in url_filter.filter_urls(df).collect()] == ["", ""] and url_filter.filter_urls(df.limit(0)).count() == 0


# -- 4 and 6


def test_tokens_are_the_librarys(texts):
    b = bpe.ForcedBoundaryBpe.shared(None)
    more = ["Hello <|endoftext|> it's I'LL İstanbul ß é 中文 \x1c a\x85b ª½ ² x²y", "<|EndOfText|>", "a b '!'s ''s 're're ªµº ²³¼ ǅ ʰ", "", " ", "<|startoftext|><|endoftext|>", "naïve" * 50, "🎉" * 30]
    every = [*texts, *more]
    want = b.pre.library.encode_batch(every, add_special_tokens=False)
    back = b.pre.library.decode_batch([e.ids for e in want], skip_special_tokens=False)
    for t, e, d in zip(every, want, back, strict=True):
        assert b.digest(t) == (len(e.ids), " ".join(map(str, e.ids)), d)
        assert b.encode(t) == e.ids and b.decode(e.ids) == d


def test_tokens_of_odd_letters_are_the_librarys():
    """Every character below the plain end, and random strings, beside letters, digits, punctuation and special tokens."""
    b, rng = bpe.ForcedBoundaryBpe.shared(None), random.Random(7)
    near = list(map(chr, range(0x250)))
    far = [*near, *(chr(rng.randrange(0x250, 0xD7FF)) for _ in range(400)), "Σ", "ς", "\u0301", "😀", "Ⅷ", "ǅ"]
    every = [f.replace("%", c) for c in near for f in ("a%b", "1%2", ",%.", "%", "A%,%B 3", "x % y", "%'S")]
    others = ["a", "B", "7", " ", ",", "\n", "<|", "'s", *b.pre.special]
    every += ["".join(rng.choice(pool if rng.random() < 0.6 else others) for _ in range(rng.randrange(1, 16))) for pool in (near, far) for _ in range(5000)]
    length = token_count.Lengths(None, token_count.frequent_lengths()).__getitem__
    for t, e in zip(every, b.pre.library.encode_batch(every, add_special_tokens=False), strict=True):
        assert b.digest(t) == (len(e.ids), " ".join(map(str, e.ids)), b.pre.library.decode(e.ids, skip_special_tokens=False)), t
        assert sum(1 if isinstance(s, int) else sum(map(length, s)) for s in b.pre.spans(t)) == len(e.ids), t


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE", 3)
    monkeypatch.setattr(bpe, "CACHE", 3)
    words = [f"zq{k}xv{c}" for k in range(10) for c in "abc"] + ["the"] * 3
    lengths, known = token_count.Lengths(None, token_count.frequent_lengths(table=2)), bpe._Cache(bpe.ForcedBoundaryBpe.shared(None).encode_piece, bpe.ForcedBoundaryBpe.shared(None).tokens)
    for w in words * 2:
        assert lengths[w] == known[w][2] == lengths.encode(w)
        assert len(lengths) <= 5 and len(known) <= 3


def test_fragments_are_cut_where_no_token_joins():
    b = bpe.ForcedBoundaryBpe.shared(None)
    inner, final = set(), set()
    for token in b.ids:
        word = token.removesuffix("</w>") if token.endswith("</w>") and len(token) > 4 else token
        pairs = [word[k : k + 2] for k in range(len(word) - 1)]
        if word != token:
            final.update(pairs[-1:])
            pairs = pairs[:-1]
        inner.update(pairs)
    for piece in ("zqxjkw", "straße", "qqzvx", "naïveté", "thehabledxq"):
        parts, chars = b.fragments(piece), b.pre.byte_level(piece)
        want, at = [], 0
        for k in range(1, len(chars)):
            if chars[k - 1 : k + 1] not in (final if k == len(chars) - 1 else inner):
                want.append(chars[at:k])
                at = k
        assert parts == [*want, chars[at:]]


def test_token_queries_odd_rows(odd, empty):
    counts = {r.doc_id: r for r in token_count.count_tokens(odd).collect()}
    digests = {r.doc_id: r for r in bpe.token_digests(odd).collect()}
    lib = bpe.ForcedBoundaryBpe.shared(None).pre.library
    for r in odd.select("doc_id", "text").distinct().collect():
        want = lib.encode(r.text or "", add_special_tokens=False)
        assert counts[r.doc_id].n_tokens == digests[r.doc_id].n_tokens == len(want.ids)
        assert counts[r.doc_id].n_bytes == len((r.text or "").encode()) and counts[r.doc_id].over_limit == (len(want.ids) > 2048)
        assert digests[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, want.ids)).encode()).hexdigest()
    assert token_count.count_tokens(empty).count() == bpe.token_digests(empty).count() == 0
    again = {r.doc_id: r.decoded for r in bpe.decode_ids(bpe.encode_texts(odd)).collect()}
    assert again == {r.doc_id: r.decoded for r in bpe.encode_texts(odd).collect()}


# -- 5


def brute_contamination(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault((n, tuple(w[k : k + n])), set()).add(str(i))
    out = []
    for t in docs:
        w = WORD.findall(lower(t))
        hit, found = [False] * len(w), set()
        for n in {n for n, _ in windows}:
            for k in range(len(w) - n + 1):
                ids = windows.get((n, tuple(w[k : k + n])))
                if ids:
                    found |= ids
                    hit[k : k + n] = [True] * n
        out.append((len(w), hit, found))
    return out


@pytest.mark.parametrize("more", [[], [(900, "the thonble"), (901, None), (902, "..."), (903, "of"), (904, "a b c d e f g"), (0, "zz yy")]])
def test_contamination(texts, more):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall() + more
    docs = [*texts, None, "", "of", "x " * 30 + items[0][1] + " y " + items[1][1] * 2, " ".join(items[2][1].split()[:10])]
    got = decontaminate.BenchmarkIndex(items).scan([None if t is None else t.encode() for t in docs])
    want = brute_contamination(docs, items)
    assert [(n, h.tolist(), i) for n, h, i in got] == want


def test_contamination_in_blocks(spark, monkeypatch, odd, empty):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(decontaminate.contamination_digest(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(decontaminate.contamination_digest(docs, items).collect()) == one
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()}
    assert kept == {r.doc_id for r in one if not r.contaminated}
    assert decontaminate.contamination_digest(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination_digest(empty, items).count() == 0
    assert decontaminate.contamination_digest(odd, items).count() == 10


# -- 7


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><nav><a href=1>Home</a></nav></header><div id="cookie-notice">We use cookies to make this site better for you. Accept?</div>
<main><h1>Title of it</h1><p>Short.</p><p>One long paragraph of text that goes on, with <a href=x>a link</a> inside&nbsp;it &lt;ok&gt;.</p><ul><li>First item of a list in the article</li><li>second</li></ul>
<section class="comments"><h2>Comments</h2><p>I think that this is a really great article, thanks for the writing!</p></section></main>
<aside><article><h3>Related</h3><p>Some other story that you may like to read today.</p></article></aside><form><p>Sign up for our great newsletter and never miss a story.</p></form><footer>(c) 2020 Company</footer>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Title of it\nShort.\nOne long paragraph of text that goes on, with a link inside it <ok>.\nFirst item of a list in the article\nsecond"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<script>if (a<b) x</script>") == ""
    assert html_extract.main_text("<article><p>Whole text here, &amp") == "Whole text here, &"
    assert html_extract.main_text("<article><p>One.<p>Two, and the end of it<b") == "One.\nTwo, and the end of it"


WORDPRESS = """<body class="single-post"><div id="page" class="site with-sidebar"><div id="masthead"><p>The site of all the things that you want to read.</p></div>
<div id="main-menu"><ul><li>Home</li><li>About</li></ul></div><div class="hentry post"><div class="entry-header"><h1>Heading</h1></div>
<div class="entry-content"><p>First paragraph of it, which is rather long and has an end.</p><div class="adsbox-2 ad">Buy this now, it is cheap and good.</div><blockquote>A quote.</blockquote><pre>x = 1;   y</pre></div></div>
<ol class="commentlist"><li>What a nice post this is, I would like to thank you for it.</li></ol></div><div role="complementary"><p>Read our other stories about the same thing here.</p></div><div class="site-footer"><p>All that you see is ours, and ours alone.</p></div></body>"""


def test_hints():
    assert html_extract.main_text(WORDPRESS) == "Heading\nFirst paragraph of it, which is rather long and has an end.\nA quote.\nx = 1; y"


def test_given_pages():
    import html

    for (page,) in duckdb.sql(f"SELECT html FROM '{SMALL}/pages.parquet'").fetchall():
        inside = re.sub(r"<[^>]*$", "", page.split("<article>", 1)[1].split("</article>")[0])
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"<p>|</p>|</?h1>", inside)]
        assert html_extract.main_text(page) == "\n".join(b for b in want if b)


PROSE = "<p>A long paragraph of text that goes on for a good while, and then it has an end.</p>"
SAID = "A long paragraph of text that goes on for a good while, and then it has an end."


def test_pages_without_hints():
    things = "<ul><li>alpha</li><li>beta</li></ul><table><tr><td>one</td><td>two</td></tr></table>"
    assert html_extract.main_text(PROSE + things + PROSE) == f"{SAID}\nalpha\nbeta\none\ntwo\n{SAID}"
    linked = "A sentence that is linked as a whole, and that belongs to the text."
    assert html_extract.main_text(f"{PROSE}<p><a href=x>{linked}</a></p>{PROSE}") == f"{SAID}\n{linked}\n{SAID}"
    menu = "<div><ul>" + "<li><a href=x>Some place</a></li>" * 9 + "</ul></div>"
    assert html_extract.main_text(menu + PROSE + menu) == SAID


def test_elements_that_tell():
    links = "<ul>" + "<li><a href=x>Source</a></li>" * 3 + "</ul>"
    comments = f"<div class=comments>{PROSE * 30}</div>"
    assert html_extract.main_text(f"<article>{PROSE}{links}</article>{comments}") == SAID + "\nSource" * 3
    assert html_extract.main_text(f"<div class='page share-bar'><article>{PROSE * 2}</article></div><p><a href=x>Home</a>") == f"{SAID}\n{SAID}"
    assert html_extract.main_text(f"<article>{PROSE}<div class=ad>{PROSE}</div></article>") == SAID


def test_the_cut_decides():
    """Scores without the cut take prose of sidebars and notices for content; the cut takes none."""
    wrong_alone = wrong = 0
    for (page,) in duckdb.sql(f"SELECT html FROM '{SMALL}/pages.parquet'").fetchall():
        article = page.split("<article>", 1)[1].split("</article>")[0]
        kept = {b.text for b in html_extract.blocks_of(f"<article>{article}</article>")}
        blocks = html_extract.blocks_of(page)
        scores, edges = html_extract.graph_of(blocks)
        for block, alone, label in zip(blocks, scores, html_extract.minimum_cut(scores, edges), strict=False):
            wrong_alone += alone > 0 and block.text not in kept
            wrong += label and block.text not in kept
    assert wrong == 0 < wrong_alone


def test_minimum_cut_of_many_blocks():
    """Both parts of the cut, the reduction and the flow, on graphs too large for all labellings: no label can be turned,
    alone or with its neighbours, at a lower cost."""
    rng = random.Random(5)
    n = 400
    s = [rng.randint(-9, 9) for _ in range(n)]
    e = [(k, k + 1, rng.randint(3, 12)) for k in range(n - 1)] + [(rng.randrange(n), rng.randrange(n), rng.randint(1, 6)) for _ in range(n)]
    label = html_extract.minimum_cut(s, e)
    cost = lambda l: sum(abs(v) for v, x in zip(s, l, strict=True) if v and (v > 0) != x) + sum(c for a, b, c in e if l[a] != l[b])  # noqa: E731, E741
    best = cost(label)
    for a in range(n):
        for b in range(a + 1, min(n, a + 12) + 1):
            for side in (True, False):
                assert cost(label[:a] + [side] * (b - a) + label[b:]) >= best


def test_minimum_cut():
    rng = random.Random(2)
    cost = lambda s, e, l: sum(abs(v) for v, x in zip(s, l, strict=True) if v and (v > 0) != x) + sum(c for a, b, c in e if l[a] != l[b])  # noqa: E731, E741
    for _ in range(200):
        n = rng.randint(1, 8)
        s = [rng.randint(-9, 9) for _ in range(n)]
        e = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 7)) for _ in range(rng.randint(0, 12))]
        best = min(cost(s, e, [bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(s, e, html_extract.minimum_cut(s, e)) == best


def test_extract_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (1, None, "", "t"), (2, "u", "<p>" * 5000 + "A text that is long enough to be kept.", "t")], "page_id bigint, url string, html string, text string")
    assert sorted(r.n_chars for r in html_extract.extract_pages(df).collect()) == [0, 0, 38]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


# -- 8


def brute_licenses(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(text))
    have = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    out = set()
    for name, t in licenses.TEMPLATES:
        tw = re.findall(r"[a-z0-9]+", t.lower())
        g = [tuple(tw[k : k + 5]) for k in range(len(tw) - 4)]
        width = len(g) + len(g) // 4
        if any(len(set(g) & set(have[a : a + width])) >= 0.8 * len(set(g)) for a in range(max(1, len(have)))):
            out.add(name)
    return out


def test_licenses(texts):
    notice = "Some words stand first. " * 9
    more = [notice + t + ". And more words, which follow it here. " * 20 for _, t in licenses.TEMPLATES]
    long = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 200)
    more += [notice + long.replace("obtain a copy", "get one copy") + notice, long[: len(long) // 2], None, ""]
    index = licenses.LicenseIndex()
    found = index.scan([None if t is None else t.encode() for t in [*texts, *more]])
    for t, f in zip([*texts, *more], found, strict=True):
        names, want = {n for n, *_ in f}, brute_licenses(t)
        assert names <= want and bool(names) == bool(want)
    for (name, _), f in zip(licenses.TEMPLATES, found[len(texts) :], strict=False):
        assert name in {n for n, *_ in f}


def test_spdx_lines(spark):
    assert licenses.spdx(b"// a b\n// SPDX-License-Identifier: MIT\ncode") == [("MIT", 2, 4)]
    assert licenses.spdx(b"SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0) and more") == [("GPL-2.0-only", 0, 16), ("Apache-2.0", 0, 16)]
    assert licenses.spdx(None) == licenses.spdx(b"") == licenses.spdx(b"SPDX-License-Identifier:\nMIT") == []
    rows = licenses.scan_licenses(spark.createDataFrame([(1, "# SPDX-License-Identifier: ISC\n"), (2, "no license")], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.licenses for r in rows} == {1: ["ISC"], 2: []}


def test_license_recall():
    """Of templates of 20 words or more, a tenth of whose shingles is spoilt at random, nine in ten are found at least."""
    rng, index, asked, found = random.Random(9), licenses.LicenseIndex(), 0, 0
    for name, t in licenses.TEMPLATES:
        words = t.split()
        if len(words) >= 20:
            for _ in range(20):
                some = list(words)
                for k in rng.sample(range(len(some)), max(1, len(some) // 50)):
                    some[k] = "another"
                text = "Some words first. " * 30 + " ".join(some) + " Words after it." * 30
                if name in brute_licenses(text):
                    asked += 1
                    found += any(n == name for n, *_ in index.scan([text.encode()])[0])
    assert asked > 200 and found >= 0.9 * asked


def test_licenses_odd_rows(odd, empty):
    assert all(r.licenses == [] for r in licenses.scan_licenses(odd).collect()) and licenses.scan_licenses(empty).count() == 0


# -- 9


def distance(a, b):
    last = list(range(len(b) + 1))
    for k, c in enumerate(a, 1):
        new = [k]
        for j, d in enumerate(b, 1):
            new.append(min(last[j] + 1, new[-1] + 1, last[j - 1] + (c != d)))
        last = new
    return last[-1]


def test_banded_distance():
    rng = random.Random(4)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) if rng.random() < 0.3 else "".join(c for c in a if rng.random() > 0.1) + rng.choice(["", "a", "bb"])
        for e in (1, 2, 3):
            assert line_dedup.edit_distance_within(a, b, e) == (distance(a, b) <= e)


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        k, how = rng.randrange(len(out)), rng.random()
        if how < 0.3:
            out.insert(k, rng.choice("abcé"))
        elif how < 0.6:
            out.pop(k)
        else:
            out[k] = rng.choice("abcé")
    return "".join(out)


def test_line_classes(spark):
    rng = random.Random(6)
    seeds = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(32, 60))) for _ in range(12)]
    lines = [edited(s, rng.randint(0, 3), rng) for s in seeds for _ in range(6)] + ["short", "short"]
    rng.shuffle(lines)
    docs = [(k, "\n".join(lines[k * 5 : k * 5 + 5])) for k in range(len(lines) // 5 + 1)]
    where = [(d, k, t) for d, text in docs for k, t in enumerate(text.split("\n")) if len(t) >= 30]
    label = list(range(len(where)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for j in range(len(where)):
        for k in range(j):
            if distance(where[j][2], where[k][2]) <= 2:
                a, b = root(j), root(k)
                label[max(a, b)] = min(a, b)
    sizes = {}
    for k in range(len(where)):
        sizes.setdefault(root(k), []).append(where[k][:2])
    want = {x for group in sizes.values() for x in sorted(group)[1:]}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = line_dedup.repeated_lines(df).collect()
    assert {(r.doc_id, r.line) for r in rows if r.drop} == want
    assert {(r.doc_id, r.line) for r in rows} == {x for g in sizes.values() if len(g) > 1 for x in g}
    cleaned = {r.doc_id: r.text for r in line_dedup.clean_lines(df).collect()}
    assert cleaned == {d: "\n".join(t for k, t in enumerate(text.split("\n")) if (d, k) not in want) for d, text in docs}
    report = {r.doc_id: r for r in line_dedup.line_report(df).collect()}
    assert all(report[d].n_lines == len(text.split("\n")) and report[d].dropped == sorted(k for e, k in want if e == d) for d, text in docs if text)


def test_few_edits():
    rng = random.Random(9)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 90)))
        b, e = edited(a, rng.randint(0, 12), rng) if len(a) > 12 else "abc", rng.randint(0, 14)
        assert line_dedup.few_edits(a, b, e) == (distance(a, b) <= e)


def test_near_lines_grow_with_length(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 9))) for _ in range(800)]
    docs, far = [], []
    for k in range(60):
        line = rng.choices(words, k=rng.randint(40, 120))
        near = list(line)
        for _ in range(2):
            near[rng.randrange(len(near))] = rng.choice(words)
        a, b = " ".join(line), " ".join(near)
        docs += [(2 * k, a), (2 * k + 1, b)]
        if 2 < distance(a, b) <= 0.05 * max(len(a), len(b)):
            far.append(2 * k + 1)
        elif distance(a, b) > 2:
            docs.pop()
    assert len(far) > 30
    report = {r.doc_id: r for r in line_dedup.line_report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert sum(report[d].n_dropped for d in far) >= 0.95 * len(far)
    assert all(report[d].n_dropped == 0 for d in report if d % 2 == 0)


def test_copies_of_short_lines(spark, tmp_path):
    from corpus_pipeline import without_repeated_lines
    from ripplegraph.llm.queries import op9_line_dedup

    short = "é" * 20  # more bytes than 30, fewer characters
    docs = spark.createDataFrame([(1, f"All rights reserved.\n\n{short}\n  "), (2, f"{short}\n\nAll rights reserved.\n  "), (3, "All rights reserved")], "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    report = {r.doc_id: r for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert [report[d].n_linked for d in (1, 2, 3)] == [2, 2, 0] and report[1].dropped == [] and report[2].dropped == [0, 2]
    texts = {r.doc_id: r.text for r in without_repeated_lines(spark, docs, "").collect()}
    assert texts == {1: f"All rights reserved.\n\n{short}\n  ", 2: "\n  ", 3: "All rights reserved"}


def test_lines_odd_rows(odd, empty):
    rows = {r.doc_id: r for r in line_dedup.line_report(odd).collect()}
    assert rows[1].n_lines == rows[2].n_lines == 0 and rows[3].n_lines == 2 and rows[5].n_dropped == 1
    assert line_dedup.line_report(odd).count() == 10 and line_dedup.line_report(empty).count() == 0
    cleaned = line_dedup.clean_lines(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == 10


# -- 10


def test_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id < 6000")  # held out below: the others
    chain = toxicity.train(docs, train)
    rows = toxicity.score_toxicity(docs, train, chain=chain).join(labels.where("doc_id >= 6000"), "doc_id").collect()
    caught = [r.rejected for r in rows if r.toxic]
    alarms = [r.rejected for r in rows if not r.toxic]
    assert sum(caught) / len(caught) > 0.85 and sum(alarms) / len(alarms) < 0.01
    assert chain.names == [*toxicity.CATEGORIES, toxicity.FINAL] and len(chain.weights[2]) == len(chain.columns) + 3
    out = toxicity.score_toxicity(odd, train, chain=chain)
    assert out.count() == 10 and not any(r.rejected for r in out.collect()) and toxicity.score_toxicity(empty, train, chain=chain).count() == 0
    kept = toxicity.drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 10


# -- the pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = now, stage(spark, now, SMALL).cache()
        assert out.columns == docs.columns and out.count() <= before.count(), name
        now = out
    assert now.count() > 0.3 * docs.count()
    fps = simhash.near_duplicates(now)
    assert decontaminate.contamination_digest(now, spark.read.parquet(f"{SMALL}/benchmark.parquet")).where("contaminated").count() == 0
    assert fps.where("doc_id <> component_id").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert sorted(last.collect()) == sorted(corpus_pipeline.run(spark, SMALL).collect())
