"""Lines of one pattern, rows that share an id, and hashes, against brute force."""

import random

import pytest

pytest.importorskip("ripplegraph.llm")

from ripplegraph.llm import line_dedup  # noqa: E402


def classes_of(lines, near):
    """Lists of the indices that links connect."""
    label = list(range(len(lines)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for j in range(len(lines)):
        for k in range(j):
            if near(lines[j], lines[k]):
                a, b = root(j), root(k)
                label[max(a, b)] = min(a, b)
    out = {}
    for k in range(len(lines)):
        out.setdefault(root(k), set()).add(k)
    return {frozenset(v) for v in out.values()}


def test_lines_of_one_pattern_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", 16)
    rng = random.Random(11)
    lines = []
    for k in range(160):
        name = "".join(rng.choice("abcdefghij") for _ in range(rng.choice([5, 6, 9])))
        lines.append(f"2024-05-17 INFO the connection from host {name} was closed by {rng.choice(['peer', 'pear', 'the client'])} after {rng.randrange(9)} tries")
    lines += [x[:50] + rng.choice("xyz") + x[51:] for x in lines[:40]] + ["ab" * 20 + str(k) for k in range(20)] + ["ba" * 20 + "c" * (k % 5) for k in range(10)]
    lines = list(dict.fromkeys(lines))
    want = classes_of(lines, lambda a, b: line_dedup.edit_distance_within(a, b, 2))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").coalesce(3)
    found = {}
    for r in line_dedup.repeated_lines(df, percent=0).collect():
        found.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(v) for v in found.values()} == {c for c in want if len(c) > 1}


def test_crowded_signatures_do_not_pair_all(spark):
    """Unlike lines that begin and end alike meet by what is between."""
    rng = random.Random(12)
    lines = [f"this line begins as all of them do {''.join(rng.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(30))} and ends as all do" for _ in range(1200)]
    lines.append(lines[7].replace("do ", "do x", 1))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    pairs, _ = line_dedup._near_candidates(df, "text", 2, 30)
    assert pairs.count() < 12_000  # 720,600 pairs share the beginning
    assert {(r.doc_id, r.drop) for r in line_dedup.repeated_lines(df).collect()} == {(7, False), (1200, True)}


def test_rows_of_one_id_lose_their_own_lines(spark):
    only, twice = "another unique long line that nobody else has", "a line of some length that stands in two documents"
    df = spark.createDataFrame([(1, f"x\n{twice}", "p", 1), (1, f"y\n{only}", "q", 2), (0, twice, "r", 3)], "doc_id bigint, text string, _drop string, _of int")
    rows = {r._of: r for r in line_dedup.clean_lines(df).collect()}
    assert rows[1].text == "x" and rows[2].text == f"y\n{only}" and rows[3].text == twice and rows[2]._drop == "q"
    report = {(r.doc_id, r.n_linked, r.n_dropped) for r in line_dedup.line_report(df).collect()}
    assert report == {(1, 1, 1), (1, 0, 0), (0, 1, 0)}


def test_a_null_id_comes_first_and_copies_of_rows_are_one(spark):
    twice = "a line of some length that stands in two documents"
    df = spark.createDataFrame([(None, twice), (3, f"{twice}\nb"), (5, twice), (5, twice)], "doc_id bigint, text string")
    assert sorted(((r.doc_id or 0, r.text) for r in line_dedup.clean_lines(df).collect())) == [(0, twice), (3, "b"), (5, ""), (5, "")]


def test_far_lines_keep_to_the_limit(spark):
    """Near lines among those that share a passage are what brute force finds; nothing beyond the limit is linked."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=12))
    lines = []
    for _ in range(40):
        line = [*rng.choices(words, k=rng.randint(5, 30)), passage, *rng.choices(words, k=rng.randint(5, 30))]
        lines.append(" ".join(line))
        line[rng.randrange(3)] = rng.choice(words)
        lines.append(" ".join(line))
    want = classes_of(lines, lambda a, b: line_dedup.few_edits(a, b, line_dedup.edit_limit(max(len(a), len(b)))))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    found = {}
    for r in line_dedup.repeated_lines(df).collect():
        found.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(v) for v in found.values()} == {c for c in want if len(c) > 1}


def crowd_of(n, rng):
    """Unlike lines that share a passage at one place, of which only a few are near each other."""
    passage = "a passage that all of these lines share, so that they meet by it "
    body = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(120))
    lines = [passage + body() for _ in range(n)]
    return lines + [x[:80] + "!?%" + x[83:130] + "#" + x[131:] for x in lines[:12]]


@pytest.mark.parametrize("block", [2048, 40])
def test_large_groups_without_many_links_lose_none(spark, monkeypatch, block):
    """No line drawn from a group may be near any other, and yet some lines of it are near."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "GRAMS", 1)
    lines = crowd_of(150, random.Random(21))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    texts = docs.selectExpr("doc_id AS hash", "CAST(CAST(doc_id AS string) AS binary) AS node", "text")
    groups = docs.selectExpr("7L AS meet", "doc_id AS hash", "CAST(length(text) AS bigint) AS length", "0L AS at")
    none = spark.createDataFrame([], "a bigint, b bigint")
    found = {}
    for r in line_dedup._near_classes(none, groups, texts, 2, 5).collect():
        found.setdefault(bytes(r.component), set()).add(int(r.node))
    want = classes_of(lines, lambda a, b: line_dedup.few_edits(a, b, line_dedup.edit_limit(max(len(a), len(b)))))
    assert {frozenset(v) for v in found.values()} == {c for c in want if len(c) > 1} and len(found) == 12


def test_counts_of_pairs_differ_by_four_an_edit():
    rng = random.Random(22)
    for _ in range(300):
        a = [rng.choice("abcé") for _ in range(rng.randint(1, 60))]
        b, n = list(a), rng.randint(0, 5)
        for _ in range(n):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.choice("abcé")] * rng.randint(0, 1)
        one, other = line_dedup.pair_counts(["".join(a), "".join(b)]).astype(int)
        assert abs(one - other).sum() <= 4 * n


def test_lines_of_several_groups_are_compared_in_the_first():
    import numpy as np

    texts = ["one line that is long enough for this", "one line that is long enough for thus", "a very different text of the same size"]
    links = lambda *before: line_dedup.links_between(texts, np.arange(3), np.array([37, 37, 38]), list(before), np.zeros(3), 2, 5)
    assert links([], [4], [4]) == ([0], [1]) and links([3, 4], [4], [4]) == ([], [])


def test_kernels_leave_no_memory_behind():
    """What a kernel has freed goes back to the system, though something small lies above it."""
    import gc
    import re
    from pathlib import Path

    from ripplegraph.llm import rows

    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024
    kept = []

    def kernel(batches):
        for _ in batches:
            much = [bytes([k % 256]) * 100_000 for k in range(1000)]
            kept.append(bytes(100_000))
            yield len(much)

    gc.collect()
    rows.release()
    before = resident()
    assert list(rows.tidied(kernel)(iter([1, 2]))) == [1000, 1000]
    assert resident() - before < 40  # of 100 MB


def test_many_pairs_and_long_lines_are_compared_at_once(monkeypatch):
    """Limits of more than a word, all sizes in one call; groups whose pairs share a call have no links between them."""
    import numpy as np

    rng = random.Random(31)
    x, y = [], []
    for _ in range(300):
        a = [rng.choice("abcdeé") for _ in range(rng.choice([40, 300, 700, 1300, 2100]))]
        b, limit = list(a), line_dedup.edit_limit(len(a))
        for _ in range(max(0, limit + rng.choice([-2, 0, 1, 2, 9, 60]))):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.choice("abcdeé")] * rng.randint(0, 1)
        x.append("".join(a))
        y.append("".join(b))
    want = [line_dedup.few_edits(a, b, line_dedup.edit_limit(max(len(a), len(b)))) for a, b in zip(x, y)]
    alone = []
    monkeypatch.setattr(line_dedup, "few_edits", lambda *a, f=line_dedup.few_edits: alone.append(a) or f(*a))
    assert line_dedup.near(x, y, 2, 5).tolist() == want and 50 < sum(want) < 250 and len(alone) < 60

    calls = []
    monkeypatch.setattr(line_dedup, "near", lambda *a, f=line_dedup.near: calls.append(a) or f(*a))
    texts = [f"group {k} has lines that are long enough, {w} two" for k in range(40) for w in ("first", "worst", "of any kind")]
    label, length, first = np.arange(120), np.array([len(t) for t in texts]), np.arange(0, 120, 3)
    a, b = line_dedup.links_between(texts, label, length, [[]] * 120, np.zeros(120), 3, 0, first)
    assert list(zip(a, b)) == [(k, k + 1) for k in range(0, 120, 3)] and len(calls) < 4


def test_texts_are_read_once(spark, monkeypatch):
    """Lines of crowded signatures and all others get their texts from one pass over the documents."""
    asked = []
    monkeypatch.setattr(line_dedup, "_texts", lambda *a, f=line_dedup._texts: asked.append(1) or f(*a))
    lines = [f"this line begins as all of them do {k:04d}{k * k:08d} and ends as all do" for k in range(100)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    want = {k for c in classes_of(lines, lambda a, b: line_dedup.edit_distance_within(a, b, 2)) if len(c) > 1 for k in c}
    found = {r.doc_id for r in line_dedup.repeated_lines(df).collect()}
    assert len(asked) == 1 and want and want <= found


def test_shared_rows_keep_every_row(monkeypatch):
    """Whatever a task holds at once, all rows of a key of several lines come, once each, and none of the others."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sig, line = rng.integers(-300, 300, 2000), rng.integers(0, 40, 2000)
    line[sig % 2 == 0] = sig[sig % 2 == 0]  # keys of one line, in several rows
    table = pa.table({"sig": sig, "place": np.arange(2000), "hash": line})
    want = [k for k in range(2000) if len(set(line[sig == sig[k]].tolist())) > 1]
    for held in (7, 300, 5000):
        monkeypatch.setattr(line_dedup, "HELD", held)
        found = [k for b in line_dedup._shared_rows(iter(table.to_batches(max_chunksize=50))) for k in b.column(1).to_pylist()]
        assert sorted(found) == want and 500 < len(want) < 1900
    assert list(line_dedup._shared_rows(iter([]))) == []
