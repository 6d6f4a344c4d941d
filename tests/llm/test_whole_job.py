"""Operators see all of their input: no sample, no cap, no single page for many."""

import math

import numpy as np
import pytest

from tokenfjord.llm import decontam, quality, toxicity, wrapper


@pytest.mark.parametrize("n", [4096, 4097, 20_020])
def test_quality_counts_marks_and_capitals_over_all_words(n):
    words = ["plain"] * n
    words[1::2] = ["LOUD"] * (n // 2)
    words[-1] = "a#b"
    loud = words.count("LOUD")
    got = dict(zip(quality.FEATURES, quality.features(" ".join(words).encode()), strict=True))
    assert got["capital_words"] == loud / n and got["marked"] == 1 / n


def test_all_children_of_a_flat_page_are_aligned():
    def page(k, n):
        return "<body>" + "".join(f"<p>line {k} {i}</p>" for i in range(n)) + "<div>All rights kept by us</div></body>"

    trees = [wrapper.skeleton(wrapper.parse(page(k, n))) for k, n in enumerate((700, 450))]
    pairs = wrapper.align(*trees)
    assert len(pairs) == 453 and (len(trees[0]) - 1, len(trees[1]) - 1) in pairs


def test_the_notice_after_many_paragraphs_goes(spark):
    def page(k):
        return "<body>" + "".join(f"<p>line {k} {i}</p>" for i in range(205 + k)) + "<div>All rights kept by us</div></body>"

    rows = spark.createDataFrame([(k, f"https://one.example/{k}", page(k)) for k in range(6)], "page_id long, url string, html string")
    for r in wrapper.extract(rows).collect():
        assert r["text"] == "\n\n".join(f"line {r['page_id']} {i}" for i in range(205 + r["page_id"]))


def test_the_template_decides_inside_and_outside_a_marked_article(spark):
    def page(k):
        return f"<body><div>Old Harbour Gazette</div><div>Teaser {k}</div><article><h1>Story {k}</h1><div class=x>Read more in our app</div><p>It ends with {k * 7}.</p></article></body>"

    rows = [(k, f"https://one.example/{k}", page(k)) for k in range(6)] + [(100, "https://two.example/", page(100))]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == f"Teaser {k}\n\nStory {k}\n\nIt ends with {k * 7}."
    assert got[100] == "Story 100\n\nRead more in our app\n\nIt ends with 700."


def test_deep_pages_have_a_text():
    page = "<article>" + "<div>" * 3000 + "deep"
    root = wrapper.parse(page)
    tree = wrapper.skeleton(root)
    assert len(wrapper.align(tree, tree)) == 3002 and wrapper.main_text(root) == "deep"


def test_decontamination_does_not_depend_on_the_number_of_automata(spark):
    item = [" ".join(f"{name}{i}" for i in range(10)) for name in "abc"]
    filler = " ".join(f"w{i}" for i in range(16))
    bench = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    half = " ".join(item[0].split()[:8])
    other = " ".join(item[1].split()[:8])
    rows = [
        (1, f"{filler} {item[0]} {item[1]}"),
        (2, f"{filler} {item[2]} end"),
        (3, f"{half} {' '.join(filler.split()[:10])} {other}"),
        (4, filler),
        (None, f"{filler} {filler} {item[1]}"),
        (0, None),
        (4, filler),
        (5, f"b0 b1 b2 b3 {item[0]} b4 b5 b6 b7 {filler}"),
    ]
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars long")
    ways = ((1000, 1 << 20), (10, 1 << 30), (10, 1))  # one automaton, several in one pass, several passes
    one, many, more = (sorted(map(tuple, decontam.decontaminate(docs, bench, most_words=n, most_bytes=b).collect()), key=str) for n, b in ways)
    assert more == many == one and len(one) == 6
    assert (5, f"b0 b1 b2 b3  b4 b5 b6 b7 {filler}") in {r[:2] for r in one}
    few, more = (sorted(r[0] for r in decontam.decontaminate(docs.where("doc_id = 3"), bench, most_items=9, most_words=n).collect()) for n in (1000, 10))
    assert few == more == []


def test_each_layout_of_a_host_has_its_template(spark):
    def one(k):
        return f"<body><p>Story {k}</p><div>Printed in the harbour</div></body>"

    def two(k):
        return f"<body><section><h2>Picture {k}</h2><ul><li>Seen by many {k}</li><li>Ask us for prints</li></ul></section></body>"

    rows = [(k, (one, two)[k % 2](k)) for k in range(12)] + [(50, ""), (51, "<body><p>Not found")]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame([(k, f"https://one.example/{k}", x) for k, x in rows], "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(12)] == [(f"Story {k}", f"Picture {k}\n\nSeen by many {k}")[k % 2] for k in range(12)]
    assert got[50] == "" and got[51] == "Not found"


def test_references_as_rows_give_the_broadcast_ones_results(spark, small, monkeypatch):
    table = spark.read.parquet(f"{small}/pages.parquet")
    assert table.count() > 100
    one = sorted(map(tuple, wrapper.extract(table).collect()))
    monkeypatch.setattr(wrapper, "MOST_BROADCAST", -1)
    monkeypatch.setattr(wrapper, "GROUP_ROWS", 7)
    assert sorted(map(tuple, wrapper.extract(table).collect())) == one


def test_pages_without_a_host_have_no_template(spark):
    rows = [(k, url, f"<body><p>Same line</p><p>Other {k}</p></body>") for k, url in enumerate([None, "", "no host", "/a"] * 3)]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Same line\n\nOther {k}" for k in range(12)}


def test_remembered_alignments_equal_new_ones():
    def page(k):
        return "<body>" + "".join(f"<p>{'same' if (k + i) % 3 else i}</p>" for i in range(k % 7)) + "<div>All rights<ul><li>x</ul></div></body>"

    trees = [wrapper.skeleton(wrapper.parse(page(k))) for k in range(40)]
    reference = wrapper.Reference(trees[5])
    for tree in trees * 2:
        assert reference.align(tree) == wrapper.align(trees[5], tree)
    assert wrapper._unpack(wrapper._pack(trees[6])) == trees[6] and wrapper._unpack("") == []


def test_packed_automata():
    items = [("a", b"one two three one two four".split()), ("b", b"two four".split()), ("c", [])]
    grown = decontam.Automaton(items, window=3)
    read = decontam.Automaton.unpack(grown.pack())
    for text in (b"x one two three one y", b"two four", b"one two four two four", b"", b"four two"):
        a, b = grown.hits(text.split()), read.hits(text.split())
        assert a[0].tolist() == b[0].tolist() and a[1] == b[1]
    assert read.hits(b"z two four z".split())[1] == {"b"} and read.hits(b"one two three".split())[1] == {"a"}


def test_label_model_against_plain_loops():
    draw = np.random.default_rng(4)
    true = draw.random(150) < 0.3
    fired = np.array([[draw.random() < (0.8 if t else 0.1) for _ in range(4)] for t in true], float)
    fired = np.column_stack([fired, fired[:, 0]])  # a copy of a voter
    label = true ^ (draw.random(150) < 0.1)
    n, m = fired.shape
    start = [[(sum(fired[i][v] for i in range(n) if label[i] == c) + 0.5) / (sum(label[i] == c for i in range(n)) + 1) for v in range(m)] for c in (0, 1)]
    balance = sum(map(bool, label)) / n
    post = [float(x) for x in label]
    for _ in range(toxicity.ROUNDS):
        rate = []
        for c in (0, 1):
            weight = [p if c else 1 - p for p in post]
            rate.append([min(1 - 1e-5, max(1e-5, (sum(w * fired[i][v] for i, w in enumerate(weight)) + toxicity.PRIOR * start[c][v]) / (sum(weight) + toxicity.PRIOR))) for v in range(m)])
        left = [[fired[i][v] - post[i] * rate[1][v] - (1 - post[i]) * rate[0][v] for v in range(m)] for i in range(n)]
        spread = [math.sqrt(sum(r[v] ** 2 for r in left) / n) + 1e-6 for v in range(m)]
        share = []
        for v in range(m):
            others = [abs(sum(r[v] * r[u] for r in left) / n / spread[v] / spread[u]) for u in range(m) if u != v]
            share.append(1 / (1 + sum(x for x in others if x > toxicity.CORRELATED)))
        post = []
        for i in range(n):
            gain = math.log(balance / (1 - balance))
            for v in range(m):
                f = fired[i][v]
                gain += share[v] * (f * math.log(rate[1][v] / rate[0][v]) + (1 - f) * math.log((1 - rate[1][v]) / (1 - rate[0][v])))
            post.append(1 / (1 + math.exp(-max(-30, min(30, gain)))))
    got = toxicity.label_model(fired, label)
    assert np.allclose(got["posterior"], post) and np.allclose(got["rate"], rate) and np.allclose(got["share"], share)
    assert got["share"][0] < 0.6 < got["share"][1] and ((got["posterior"] > 0.5) == true).mean() > 0.85


def test_votes_by_hand():
    counts = np.array([[3, 0, 1000], [1, 1, 100], [0, 0, 50], [1, 0, 10]], float)
    first = toxicity.votes(counts)
    assert first[:, 0].tolist() == [1, 1, 0, 1] and first[:, 1].tolist() == [0, 1, 0, 0]
    assert first[1, 2:8].tolist() == [1, 1, 1, 1, 1, 1] and not first[0, 2:8].any() and not first[3, 2:8].any()
    assert first[:, 8:].tolist() == [[1, 1], [0, 0], [0, 0], [0, 0]]


def test_pair_weights_are_the_best_ones():
    """Newton's method on the same pairs, in plain arithmetic, ends at the same weights."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 3))
    good = x @ np.array([1.0, -0.5, 0.0]) + draw.normal(size=300) > 0.3
    model = quality.fit_pairs(x, good)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    again = np.random.default_rng(7)
    up, down = z[good], z[~good]
    pairs = up[again.integers(0, len(up), quality.PAIRS)] - down[again.integers(0, len(down), quality.PAIRS)]
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-pairs @ w))
        gradient = pairs.T @ (1 - p) / len(pairs) - quality.RIDGE * w
        hessian = (pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + quality.RIDGE * np.eye(3)
        w = w + np.linalg.solve(hessian, gradient)
    assert np.allclose(model["w"], w, atol=0.01)
    assert abs((z @ model["w"] < model["cut"]).mean() - (~good).mean()) < 0.01
