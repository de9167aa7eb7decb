"""Page texts, toxicity, packing and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import clashing, no_docs, odd_docs, odd_rows
from tipweave.llm import html_text, packing, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARAGRAPH = "This paragraph is long enough, and it has marks, to count as text. "

PAGES = [
    ("<html><head><title>no</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Head</h1>"
     f"<p>{PARAGRAPH}<p>Short.<ul><li>one<li>two</ul></article><footer>Foot</footer></body>",
     f"Head\n{PARAGRAPH.strip()}\nShort.\none\ntwo"),
    (f"<body class='has-sidebar'><div class='sidebar'>{PARAGRAPH}</div><div class=post><h2>T</h2>"
     f"<p>{PARAGRAPH * 3}</p><p>x &lt; y &amp;&nbsp;z</p></div><div id='comments'><p>{PARAGRAPH}</p></div>",
     f"T\n{(PARAGRAPH * 3).strip()}\nx < y & z"),
    (f"<article><header><h1>Title</h1><p>by someone</p></header><script>if (a<b) x('</p>')</script>"
     f"<p>{PARAGRAPH}a<b>b</b>c<br>d<!-- no --></p><form>Name <input></form></article>",
     f"Title\n{PARAGRAPH}abc d"),
    (f"<main><p>{PARAGRAPH}</p><div class='cookie-notice'>We use cookies, a lot.</div>"
     f"<section class='related'><p>{PARAGRAPH}</p></section><p>End</p>", f"{PARAGRAPH.strip()}\nEnd"),
    ("plain words only", "plain words only"),
    ("", ""), (None, ""), ("<nav>menu</nav>", ""), ("<p", ""), ("x<p", "x"),
    ("<a href='x>broken", "broken"),
]


def test_page_texts(spark):
    rows = [(i, f"http://x/{i}", page) for i, (page, _) in enumerate(PAGES)] * 2
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for r in html_text.page_texts(docs.withColumn("text", F.lit("mine"))).collect():
        assert r.text == PAGES[r.page_id][1], r.page_id
        assert r.n_chars == len(r.text)
    assert html_text.page_texts(docs.where("false")).count() == 0


def test_content_in_every_container_and_no_link_lists():
    long, p = (PARAGRAPH * 3).strip(), PARAGRAPH.strip()
    head = "<body><div class=top><a href=/>Home</a> <a href=/x>All of our pages</a></div>"
    for page, want in [
        (f"{head}<div class=post><div class=lead><p>{p}</p></div><div class=body><h2>T</h2><p>{long}</p>"
         f"</div></div>", [p, "T", long]),
        (f"{head}<div class=post><h2>T</h2><p>{p}</p><blockquote><p>{long}</p></blockquote><p>x</p>"
         f"<ul><li>one<li>two</ul></div>", ["T", p, long, "x", "one", "two"]),
        (f"{head}<div class=post><h2>T</h2><p>{p}</p><ul><li>{long}</li><li>{long}</li></ul></div>",
         ["T", p, long, long]),
        (f"<article><p>{p}</p><ul><li><a href=/1>Other story</a></li><li><a href=/2>One more</a></li>"
         f"</ul><p>{p}</p></article>", [p, p]),
    ]:
        assert html_text.main_text(page).split("\n") == want


def test_long_and_hostile_pages_end():
    assert html_text.main_text("<p>" * 20_000 + "x") == "x"
    assert html_text.main_text("<div>" * 3_000 + "x" + "</div>" * 10)
    html_text.main_text("<a " + "b='" * 20_000)
    html_text.main_text("<" * 50_000)


def toxic_rows(n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        text = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(80)]
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                text[rng.randrange(80)] = rng.choice(["vile", "rotten", "filthy"])
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.scored(docs, marks).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held]
    assert {r.doc_id for r in held} == {
        i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum((r.score >= toxicity.THRESHOLD) == (r.doc_id % 8 == 0) for r in held)
    assert right >= 0.97 * len(held)
    # Labels of the held-out fold change nothing.
    lied = marks.withColumn(
        "toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic"))
        .otherwise(F.col("toxic")))
    again = toxicity.scored(docs, lied).collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.text, r.score) for r in got)


def test_toxicity_takes_odd_rows(spark):
    rows, labels = toxic_rows(200)
    labels += [(None, 1, 1), (1, None, None), (1, 1, 1), (1, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = clashing(odd_docs(spark))
    got = toxicity.scored(docs, marks)
    assert set(got.columns) == set(docs.columns)  # score is replaced
    scores = [r.score for r in got.collect()]
    assert len(scores) == len(odd_rows()) and all(0 <= s <= 1 for s in scores)
    assert toxicity.scored(no_docs(spark), marks).count() == 0
    none = toxicity.scored(odd_docs(spark), marks.where("false")).collect()
    assert {r.score for r in none} == {0.0}
    kept = toxicity.without_toxic(docs, marks)
    assert set(kept.columns) == set(docs.columns)
    assert {r.score for r in kept.collect()} <= {"mine score"}


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"word{i % 97} Übung" for i in range(3000))

    def found():
        return {int(f) for _, fs in toxicity.features([text, None, ""]) for f in fs}

    whole = found()
    monkeypatch.setattr(toxicity, "PIECE", 500)
    toxicity._powers.cache_clear()
    pieces = found()
    toxicity._powers.cache_clear()
    assert pieces == whole


def test_the_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    positive = [np.array([0, 2 + rng.integers(50)]) for _ in range(60)]
    plain = [np.array([1, 2 + rng.integers(50)]) for _ in range(190)]
    hidden = [np.array([0, 2 + rng.integers(50)]) for _ in range(10)]
    w = toxicity.fit_nonnegative(positive, plain + hidden, 52, 0.05)
    assert w[0] + w[52] > 0 > w[1] + w[52]


def check_packing(got, docs, end=2, capacity=1024):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = defaultdict(Counter)
    total = 0
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        total += len(ids)
        start, size = 0, len(ids) % capacity or capacity
        piece = 0
        while start < len(ids):
            code = zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())
            want[i][piece, start, size, code] += 1
            start, size, piece = start + size, capacity, piece + 1
    for i, pieces in want.items():
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == pieces
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return total, len(sequences)


def test_packing(spark):
    rng = random.Random(6)
    rows = odd_rows() + [
        (i, " ".join(f"word{rng.randrange(999)}," for _ in range(rng.randrange(1, 300))), "en", "s", 0)
        for i in range(100, 400)]
    docs = clashing(spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = packing.pack(docs, PATH, ["doc_id"]).collect()
    total, n = check_packing(got, [(r[0], r[1]) for r in rows])
    assert n <= 1.02 * total / 1024 + 1
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack(no_docs(spark), PATH, ["doc_id"]).count() == 0


def test_packing_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 40)
    rng = random.Random(7)
    rows = [(i, "a " * rng.randrange(1, 900)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    total, n = check_packing(packing.pack(docs, PATH, ["doc_id"], with_ids=False).collect(), rows)
    assert n <= 1.03 * total / 1024 + 1


@pytest.mark.parametrize("text", [
    "", " ", "  two  spaces ", "line\nbreak \n mixed\ttabs", "it's don't we'll", "a, b. c! (d) \"e\"",
    "x%%% y### z&&& 12,5 3rd", "<|endoftext|>", "ünïcode 漢字、テスト \U0001f600 x", "trailing ",
    "word'", "'quoted' end.'", "a\x1cb \x85c", "tab\t tab",
])
def test_remembered_ids_equal_the_tokenizer(text):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    encode = packing.Encoder(PATH)
    for _ in range(2):
        got = np.frombuffer(encode(text), "<u4").tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids


def test_children_hold_every_item_once_and_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 500)
    first, second = (
        packing.best_fit(lengths, rng.permutation(500), np.full(500, -1), 1024) for _ in range(2))
    for _ in range(20):
        child = packing.child_of(lengths, first, second, 1024, rng)
        assert (child >= 0).all() and np.bincount(child, lengths).max() <= 1024
        assert (np.unique(child) == np.arange(child.max() + 1)).all()
        first, second = child, first
    best = packing.evolve(lengths, [first, second], 1024, rng)
    assert packing.cost(lengths, best, 1024) <= packing.cost(lengths, first, 1024)


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = out.checkpoint()
        if name == "toxicity":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            clean = [i for i, t in labels.items() if not t]
            assert sum(i in kept for i in clean) >= 0.95 * len(clean)
        elif name == "line dedup":
            assert docs.count() == len(kept)
        elif name == "near-dedup":
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and set(ids) <= kept
    assert before >= len(kept)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    packed = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check_packing(packed, rows)
    assert pipeline.run(spark, folder).count() == len(packed)
