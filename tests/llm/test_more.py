"""What findings asked for: model formats, repeated and null ids, empty partitions, page shapes, recall of fuzzy lines."""

import random
import time
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as schema

from sieveline.llm import html_extract, knn_join, license_scan, line_dedup, minhash, quality_classifier, sentencepiece_wfst, toxicity
from sieveline.plans import lineage

BIG = 2**53 + 1
SMALL = "/root/testdata/sf0.001"


def tiny_model(kind, fallback, user, charsmap):
    proto = schema.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = kind, fallback
    spec = proto.normalizer_spec
    spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = charsmap, True, True, True
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(u, 0, 4) for u in user] + [(f"<0x{b:02X}>", 0, 6) for b in range(256) if fallback]
    rows += [(w, -float(k) - 1 if kind == 2 else -2.0 - 0.37 * k / len(w), 1) for k, w in enumerate("▁ a b g o s ab og dog ▁d ▁do ▁dog gs do as ▁a ba aba 1 fi".split())]
    for piece, score, type_ in rows:
        added = proto.pieces.add()
        added.piece, added.score, added.type = piece, score, type_
    return proto.SerializeToString()


@pytest.mark.parametrize("kind", [sentencepiece_wfst.UNIGRAM, sentencepiece_wfst.BPE])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("user", [(), ("dogs", "d", "@@")])
@pytest.mark.parametrize("mapped", [True, False])
def test_models_equal_the_library(kind, fallback, user, mapped):
    charsmap = schema.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).normalizer_spec.precompiled_charsmap
    model = tiny_model(kind, fallback, user, charsmap if mapped else b"")
    rng = random.Random(4)
    texts = ["", "  ", " dog dogs", "漢字 dog漢漢a字", "adogs dogdog", "ﬁx ① Å", "x\ty  z"] + ["".join(rng.choice("abdgos dog 漢ﬁ①é　") for _ in range(rng.randrange(30))) for _ in range(200)]
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_wfst.Transducer.parse(model)
    assert [own.encode(t) for t in texts] == [library.encode(t) for t in texts]


def test_ids_beside_nulls_stay_exact(spark):
    rows = spark.createDataFrame([(BIG, "mit license x"), (None, "a b"), (BIG + 2, None)], "doc_id bigint, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    for found in (license_scan.license_verdicts(rows), minhash.near_duplicate_rows(rows), toxicity.toxicity_scores(rows, labels), quality_classifier.classify(rows), line_dedup.deduplicated_lines(rows), sentencepiece_wfst.tokenized(rows)):
        out = found.collect()
        assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(map(str, (BIG, BIG + 2, None)))
        assert all(r[c] is not None for r in out for c in ("kept", "held_out") if c in found.columns)
    pages = rows.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("text").alias("html"))
    assert {r["page_id"] for r in html_extract.extract_text(pages).collect()} == {BIG, BIG + 2, None}


def test_empty_partitions(spark):
    rows = spark.createDataFrame([(1, "one two three four five six"), (2, "seven")], "doc_id bigint, text string").repartition(6)
    for operator in (quality_classifier.classify, license_scan.license_verdicts, minhash.near_duplicate_rows, line_dedup.deduplicated_lines, sentencepiece_wfst.tokenized):
        assert operator(rows).count() == 2 and operator(rows.where("doc_id > 5")).count() == 0
    labels = rows.select("doc_id", F.lit(1).alias("toxic"))
    assert toxicity.toxicity_scores(rows, labels).count() == 2 and toxicity.toxicity_scores(rows.where("doc_id > 5"), labels).count() == 0


@pytest.mark.parametrize(
    "html,text",
    [
        ("<div class='content with-sidebar'><article><p>Story here.</p></article></div>", "Story here."),
        ("<div class='page no-sidebar'><p>Story here.</p></div>", "Story here."),
        ("<form action='/'><div><p>Story here is long.</p></div></form>", "Story here is long."),
        ("<p title='it's'>Text one</p><p>Text 'two'</p>", "Text one\nText 'two'"),
        ('<p class="x>kept text</p><p class="y">two</p>', "kept text\ntwo"),
        ("<div><h1>Main</h1><p>The main story is long and goes on.</p></div><article class='card'><p>Teaser</p></article>", "Main\nThe main story is long and goes on.\nTeaser"),
        ("<main><h1>T</h1><article><p>One</p></article><p>more</p></main>", "T\nOne\nmore"),
        ('<p data-h="<b>x</b>">ok</p><div class="site-footer">no</div>', "ok"),
    ],
)
def test_page_shapes(html, text):
    assert html_extract.main_text(html) == text


def test_deep_and_long_pages():
    assert html_extract.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert html_extract.main_text("<p>y</p>" + '<p a="x ' * 20_000).startswith("y")


def test_style_tree_removes_what_no_list_knows(spark):
    """Branches without any word of the lists go if a host's pages repeat them."""
    page = "<html><body><div class='zq'>Offers of the {0}</div><div class='k'><p>The story of {1} is told here at some length, number {1}.</p></div><div class='ww'>Call us at once</div></body></html>"
    rows = [(k, "http://shop.example/", page.format("week", k)) for k in range(6)]
    found = html_extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["text"] for r in found} == {f"The story of {k} is told here at some length, number {k}." for k in range(6)}


def letters(text):
    return np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256).astype(np.int32)


def test_recall_of_fuzzy_lines(spark):
    """Components of all alike pairs of lines of five words or more, by brute force; lengths and letters rule out the rest."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(120)
    texts = [r["text"] for r in documents.collect() if r["text"]]
    norms = sorted({n for t in texts for line in t.split("\n") for n in [line_dedup.OTHER.sub(" ", line.lower()).strip()] if len(n.split()) >= 5 and len(n) < 600}, key=len)
    counts, sizes = np.stack([letters(n) for n in norms]), np.array([len(n) for n in norms])
    wanted = []
    for i in range(len(norms)):
        near = np.arange(i + 1, np.searchsorted(sizes, sizes[i] / line_dedup.SIMILARITY, side="right"))
        apart = np.abs(counts[near] - counts[i]).sum(axis=1) / 2
        wanted += [(i, int(j)) for j in near[apart <= 2 * (1 - line_dedup.SIMILARITY) * sizes[near]] if line_dedup.alike(norms[i], norms[int(j)])]
    frame = spark.createDataFrame([(k, n) for k, n in enumerate(norms)], "doc_id bigint, text string")
    line_dedup.small_batches(spark)
    lines = line_dedup.stored(line_dedup.described_lines(frame))
    ids = {r["id"]: r["doc_id"] for r in lines.collect()}
    parts = {ids[r["node"]]: r["component"] for r in line_dedup.linked_classes(lines, frame).collect()}
    met = sum(i in parts and parts.get(i) == parts.get(j) for i, j in wanted)
    assert len(wanted) >= 5 and met >= 0.9 * len(wanted)


def test_edit_distances():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = [i] + [0] * len(b) if not b else [v for v in _next(row, c, b, i)]
        return row[-1]

    def _next(row, c, b, i):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        return new

    words = ["", "a", "ab", "abc", "acb", "bca", "abca", "cabba", "aaaa", "bbbbb"]
    for a, b in combinations(words, 2):
        for limit in range(6):
            assert line_dedup.edit_distance_within(a, b, limit) == (distance(a, b) <= limit)


def test_products_beyond_floats(spark):
    one, two = 2**27 + 1, 2**27
    frame = spark.createDataFrame([(0, [one, 1]), (1, [one, 0]), (2, [two, 3]), (3, [one, 1])], "vec_id bigint, v array<bigint>")
    found = knn_join.top_k(frame, frame.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(3, one * one + 1), (1, one * one), (2, one * two + 3)]


def test_sketches_gate_every_pair(spark):
    """A pair whose sketch estimate is low is never confirmed, whatever bucket it came from."""
    low, high = np.zeros(16, np.int64).tolist(), np.full(16, -1, np.int64).tolist()
    classes = spark.createDataFrame([(1, low), (2, high), (3, low)], "rep bigint, sketch array<bigint>")
    pairs = spark.createDataFrame([(2, 1), (3, 1)], "a bigint, b bigint")
    assert [tuple(r) for r in minhash.sketched(pairs, classes, 80).collect()] == [(3, 1)]


def test_a_passage_in_many_lines_hides_no_alike_pair(spark):
    """Two alike lines whose only shared keys stand in a passage that more than 32 other lines hold."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passage = "extraordinarily knowledgeable representatives"
    lines = [f"{passage} {' '.join(word() for _ in range(3))}" for _ in range(60)]
    one = "extraordinarily knowledgeable representatives abcdefgh ijklmnop"
    other = "extraordinarily knowledgeable representatives abXdefgh ijkXmnop"
    frame = spark.createDataFrame(list(enumerate([*lines, one, other])), "doc_id bigint, text string")
    found = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicated_lines(frame).collect()}
    norm = {k: line_dedup.OTHER.sub(" ", t.lower()).strip() for k, t in enumerate([*lines, one, other])}
    parts = {k: k for k in norm}
    for a, b in combinations(norm, 2):
        if line_dedup.alike(norm[a], norm[b]):
            low, high = sorted((parts[a], parts[b]))
            parts = {k: low if v == high else v for k, v in parts.items()}
    assert parts[60] == parts[61] and {k for k, n in found.items() if n} == {k for k, v in parts.items() if k != v}


def test_starts_allow_what_the_whole_allows():
    rng = random.Random(2)
    for _ in range(400):
        x = "".join(rng.choice("abcd ") for _ in range(rng.randrange(5, 150)))
        y = "".join(rng.choice(["", c, c + "a", "b"]) if rng.random() < 0.2 else c for c in x)
        limit = line_dedup.edits_allowed(x, y)
        if line_dedup.edit_distance_within(x, y, limit):
            assert line_dedup.starts_allow(x, y, limit) and line_dedup.starts_allow(y, x, limit)
    assert not line_dedup.starts_allow("abcdefghij" * 9, "klmnopqrst" * 9, 18)


def test_copies_of_copies_are_confirmed_in_few_pairs(spark, monkeypatch):
    """A long chain of edits is one component, and each class is confirmed against a few others, not against all."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(150):
        words[rng.randrange(150)] = f"w{rng.randrange(10**6)}"
        words[rng.randrange(150)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    asked, confirm = [], minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda pairs, *rest: asked.append(pairs.count()) or confirm(pairs, *rest))
    found = minhash.near_duplicate_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    sets = [minhash.shingles(t, 2) for t in texts]
    assert all(100 * len(a & b) >= 80 * len(a | b) for a, b in zip(sets, sets[1:], strict=False))
    assert {r["component_id"] for r in found} == {0} and sum(asked) < 8 * len(texts)


@pytest.mark.parametrize("block", [2048, 16])
def test_unlike_copies_of_one_text_are_not_confirmed_pair_by_pair(spark, monkeypatch, block):
    """Near copies about the threshold: sketches can't tell most of them apart, few are linked, and only the pairs with
    leaders are joined as rows; the rest meets in one task, or in blocks of parts."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(f"w{rng.randrange(10**6)}" if rng.random() < 0.038 else w for w in base) for _ in range(120)]
    sets, parts = [minhash.shingles(t, 2) for t in texts], {k: k for k in range(len(texts))}
    for a, b in combinations(parts, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((parts[a], parts[b]))
            parts = {k: low if v == high else v for k, v in parts.items()}
    asked, confirm = [], minhash.confirm
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "confirm", lambda pairs, *rest: asked.append(pairs.count()) or confirm(pairs, *rest))
    found = minhash.near_duplicate_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == parts and len(set(parts.values())) > 5
    assert sum(asked) <= minhash.LEADERS * len(texts)


def test_rows_of_blocks_are_stored_as_tables_and_go(spark, monkeypatch):
    """A block's rows, the most of line dedup, are never checkpointed row by row; of their tables only the dealt classes stay."""
    checkpointed, tables, cut, stored = [], [], line_dedup.cut, line_dedup.stored
    monkeypatch.setattr(line_dedup, "cut", lambda frame: checkpointed.append(frame.columns) or cut(frame))
    monkeypatch.setattr(line_dedup, "stored", lambda frame: tables.append(stored(frame)) or tables[-1])
    texts = ["the quick brown foxes jumped over lazy dogs today", "the quick brown foxes jumped over lazy dogs todax", "the quick brown foxes jumped over lazy cats elsewhere"]
    found = line_dedup.deduplicated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {0: 0, 1: 1, 2: 0}
    assert not [c for c in checkpointed if "block" in c]
    kept = [set(t.columns) for t in tables if any(Path(f.removeprefix("file://")).exists() for f in t.inputFiles())]
    assert len(tables) > 3 and kept[1:] == [{"block", "id", "simhash", "length"}]


def test_shuffles_go_with_their_execution(spark, monkeypatch):
    """When a step of line dedup is stored, nothing that it shuffled is left, and the session's setting is as before."""
    folders = [Path(p) for p in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f.name for folder in folders for f in folder.glob("*/shuffle_*.data")}
    before, setting, left = files(), spark.conf.get(lineage.CLEANUP, None), []

    def seen(frame):
        end = time.monotonic() + 3
        while files() - before and time.monotonic() < end:
            time.sleep(0.05)
        left.append((frame.columns, len(files() - before)))
        return frame

    cut, stored = line_dedup.cut, line_dedup.stored
    monkeypatch.setattr(line_dedup, "cut", lambda frame: seen(cut(frame)))
    monkeypatch.setattr(line_dedup, "stored", lambda frame: seen(stored(frame)))
    texts = ["the quick brown foxes jumped over lazy dogs today", "the quick brown foxes jumped over lazy dogs todax", "the quick brown foxes jumped over lazy cats elsewhere"]
    found = line_dedup.deduplicated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {0: 0, 1: 1, 2: 0}
    assert len(left) > 5 and not [x for x in left if x[1]]
    assert spark.conf.get(lineage.CLEANUP, None) == setting


def test_rows_decode_side_by_side_and_pieces_end_where_the_automaton_says(monkeypatch):
    """Ids of all rows are decoded at once, one by one only if the bytes aren't UTF-8; each state has all pieces that end there."""
    model = sentencepiece_wfst.Transducer.load()
    texts = ["two  words", None, "", " a space before", "日本 🎉 ünï", "x" * 40, "unbelievable"]
    rows = sentencepiece_wfst.arrow_lists([None if t is None else model.encode_packed(t) for t in texts])
    odd = sentencepiece_wfst.arrow_lists([np.array(ids, np.int32).tobytes() for ids in ([1, *model.encode("after a control id")], [model.byte_ids[0xFF]], model.encode("fine"))])
    one_by_one = [[None if ids is None else model.decode(ids) for ids in x.to_pylist()] for x in (rows, odd)]
    assert model.decode_rows(odd).to_pylist() == one_by_one[1] and "�" in one_by_one[1][1]
    monkeypatch.setattr(model, "decode", None)
    assert model.decode_rows(rows).to_pylist() == one_by_one[0] and model.decode_rows(rows[3:6]).to_pylist() == one_by_one[0][3:6]
    state, text = model._arcs, "▁unbelievable日本▁internationally"
    for end, c in enumerate(text, 1):
        state = state[c]
        assert [(n, i) for n in range(end, 0, -1) if (i := model.ids.get(text[end - n : end])) is not None] == list(state.arcs)
