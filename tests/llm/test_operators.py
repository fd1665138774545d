"""The text operators against brute force, round trips, SQL and held-out labels."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from sieveline.llm import html_extract, knn_join, license_scan, line_dedup, minhash, mixing, quality_classifier, quality_rules, sentencepiece_wfst, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def table(spark, name, folder=SMALL):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.mark.parametrize("name,sql,operator", [("documents", quality_rules.rules_sql(), quality_rules.rule_verdicts), ("embeddings", knn_join.KNN_SQL, knn_join.nearest_vectors)])
def test_against_sql(spark, name, sql, operator):
    database = duckdb.connect()
    database.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    relation = database.sql(sql)
    frame = operator(table(spark, name))
    assert sorted(map(tuple, frame.select(*relation.columns).collect()), key=repr) == sorted(relation.fetchall(), key=repr)


def test_rules_keep_clean_and_reject_junk(spark):
    found = quality_rules.rule_verdicts(table(spark, "documents", MIDDLE)).join(table(spark, "labels", MIDDLE), "doc_id").where("n_words >= 50").toPandas()
    assert found[found["quality"] == 1]["kept"].mean() > 0.98 and found[found["quality"] == 0]["kept"].mean() < 0.1


def test_repeated_windows_by_words(spark):
    """The exact way for colliding hashes counts what the fast way counts."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("a b c x a b c y a b c",), ("a a a a a",), ("one two three four",)], "text string").select(F.split("text", " ").alias("w"))
    starts = [sorted(r[0]) for r in frame.select(quality_rules.starts_by_words(F.col("w"))).collect()]
    assert starts == [[0, 4, 8], [0, 1, 2], []]


def components(texts, width, percent):
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()) for i, t in texts.items() for w in [words(t)]}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    for k in range(80):  # a chain of edits: far ends differ, neighbours don't
        base[rng.randrange(60)] = f"new{k}"
        texts[10_000 + k] = " ".join(base)
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for width in (2, 5):
        found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, width=width).collect()}
        assert found == components(texts, width, 80)


def test_classes_that_lose_all_pairs_stay_candidates(spark):
    """A class that leads each bucket it shares, by id and by hash, whose partners keep three other leaders."""
    from pyspark.sql import functions as F

    x = spark.range(1, 100).orderBy(F.xxhash64("id")).first()["id"]
    ids = range(x + 1, 200)
    leaders, partners = ids[:3], ids[50:52]
    rows = [(10 * n + k, r) for n, leader in enumerate(leaders) for k in (0, 1) for r in (leader, *partners)] + [(99, r) for r in (x, *partners)]
    banded = spark.createDataFrame(rows, "key bigint, rep bigint")
    kept = {i for r in minhash.leader_pairs(banded).collect() for i in r}
    assert x not in kept and {r["rep"] for r in minhash.sharing(banded).collect()} == {x, *leaders, *partners}


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.concatenate((a[:900], np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))))
    x, y = (minhash.odd_sketch(minhash.samples_of(np.sort(s))) for s in (a, b))
    assert abs(minhash.estimates(x, y[None])[0] - 900 / 1100) < 0.12


def test_encoding_equals_the_library(spark):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_wfst.MODEL_PATH), sentencepiece_wfst.Transducer.load()
    rng = random.Random(3)
    texts = [r["text"] for r in table(spark, "documents").limit(100).collect()] + [" " * n + "a" + " " * n for n in range(40)]
    texts += ["".join(rng.choice("aet hons \n\té漢😀.,19") for _ in range(rng.randrange(50))) for _ in range(1500)]
    texts += ["".join(rng.choice(own.pieces[259:]) for _ in range(4)).replace("▁", " ") for _ in range(1500)]
    assert [own.encode(t) for t in texts] == [library.encode(t) for t in texts]
    assert all(own.decode(own.encode(t)) == t for t in texts)
    rows = sentencepiece_wfst.tokenized(table(spark, "documents")).where("NOT round_trip").count()
    assert rows == 0


def test_unigram_shortest_path():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁a", -4.2, 1), ("ba", -5.0, 1), ("▁ab", -9.0, 1)]
    model = sentencepiece_wfst.Transducer(*map(list, zip(*pieces)), sentencepiece_wfst.UNIGRAM)
    for text in ("ab", "abba", "ba ab", "aab"):
        normal, best = model.normalise(text), None
        todo = [(0.0, 0, [])]
        while todo:
            cost, at, ids = todo.pop()
            if at == len(normal):
                best = min(best or (9e9, []), (cost, ids), key=lambda x: x[0])
            todo += [(cost - s, at + len(p), [*ids, k]) for k, (p, s, kind) in enumerate(pieces) if kind == 1 and normal.startswith(p, at)]
        got = model.encode(text)
        assert abs(-sum(pieces[i][1] for i in got) - best[0]) < 1e-9


def test_segments_against_their_definition():
    def maximal(scores, low, high):
        """The best segment (shortest of equals), and the same of what lies left and right of it."""
        best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a = -best[2]
        b = a - best[1]
        return [*maximal(scores, low, a), (a, b, best[0]), *maximal(scores, b, high)]

    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-7, -5, -3, -2, 1, 2, 4, 8]) + rng.random() / 64 for _ in range(rng.randrange(14))]
        found = toxicity.segments(np.array(scores))
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in maximal(scores, 0, len(scores))]


def test_toxicity_on_held_out_rows(spark):
    documents, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    found = toxicity.toxicity_scores(documents, labels).where("held_out").join(labels, "doc_id").toPandas()
    ranks = found["score"].rank()
    toxic = found["toxic"] == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.93 and found[~toxic]["predicted"].mean() < 0.03 and found[toxic]["predicted"].mean() > 0.65


def test_quality_classifier_finds_junk(spark):
    found = quality_classifier.classify(table(spark, "documents", MIDDLE)).join(table(spark, "labels", MIDDLE), "doc_id").toPandas()
    assert found[found["quality"] == 1]["kept"].mean() > 0.98 and found[found["quality"] == 0]["kept"].mean() < 0.15


def test_vote_model_weighs_labellers():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    votes = np.where(rng.random((4000, 4)) < [0.95, 0.9, 0.85, 0.6], good[:, None], ~good[:, None]).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_classifier.fit_votes(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.05 and ((model.good(votes) >= 0.5) == good).mean() > 0.93


def test_mix_meets_targets(spark):
    found = mixing.mixed_documents(table(spark, "documents", MIDDLE)).join(table(spark, "documents", MIDDLE).select("doc_id", "source"), "doc_id").toPandas()
    assert len(found) == 1000 and (found["taken"] <= 2 * found["size"]).all() and (found["taken"] % found["size"].clip(lower=1) == 0).all()
    by = found.groupby("source").agg(size=("size", "sum"), all=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["all"]).all() and ((by["taken"] - by["target"]).abs() <= 0.01 * by["target"]).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-3
    free = by[by["target"] < 2 * by["size"] - 1e-6]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(by.index))}
    shares = [t / weight[s] for s, t in free["target"].items()]
    assert max(shares) - min(shares) < 1e-6 * max(shares)
    again = mixing.mixed_documents(table(spark, "documents", MIDDLE).repartition(7)).select("doc_id", "taken").toPandas()
    assert dict(zip(again["doc_id"], again["taken"])) == dict(zip(found["doc_id"], found["taken"]))


def test_tilted_rates_are_optimal():
    sizes, counts = np.array([1.0, 5.0, 40.0]), np.array([10.0, 4.0, 2.0])
    for target in (20.0, 110.0, 150.0, 219.0):
        rates = mixing.tilt(sizes, counts, target, 2)
        assert abs((sizes * counts * rates).sum() - target) < 1e-5 * target
        inner = rates < 2 - 1e-12
        slopes = np.log(rates[inner]) / sizes[inner]
        assert np.ptp(slopes) < 1e-9


def test_licenses_by_words(spark):
    texts = ["Released under the MIT License.", "x mit-license MIT\nLicense mité license", "GNU General Public License, version 3. general public licenses", "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0", "nothing"]
    found = license_scan.license_verdicts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    phrases = [(p.encode().split(), label) for p, label in license_scan.BASE]
    for row, text in zip(found, texts, strict=True):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())
        places = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        assert (row["n_words"], row["n_base"]) == (len(w), len(places))
        assert (row["first_word"], row["last_word"]) == (min(places)[0] if places else None, max(places)[0] if places else None)
        assert row["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
    assert "cc-by-nc" in found[3]["labels"].split(",") and found[4]["score"] == 0 and len(license_scan.signatures()) > 300


@pytest.mark.parametrize("text,label", [("licensed under the GPL", "gpl"), ("under the terms of the GPL", "gpl"), ("GPLv2", "gpl"), ("GPLv3+", "gpl"), ("LGPLv2.1", "lgpl"), ("GPL v3", "gpl"), ("GPL version 2 or any later version", "gpl"), ("Apache 2", "apache"), ("license: MIT", "mit"), ("CC-BY-SA", "cc-by-sa"), ("released under a CC BY-SA 4.0 licence", "cc-by-sa"), ("we submit it under protest, cc by mail", "")])
def test_notices_in_their_common_forms(text, label):
    assert license_scan.scan(text)[5] == label


def test_version_is_part_of_the_detection():
    assert [d[1:3] for d in license_scan.scan("the GNU General Public License v3")[-1]] == [(1, 6)]


def test_suppression_keeps_the_longer_rule():
    body = b"licensed under the gnu lesser general public license"
    kept = license_scan.detect(body, license_scan.word_starts(body))
    assert [d.rule.label for d in kept] == ["lgpl"]


PAGE = "<html><head><title>T</title><script>var x='</p>';</script></head><body><header>Site</header><nav>Menu</nav><div class='box'>Same words on every page</div>{body}<aside>Side</aside><form>Name</form><div id='comments'>First!</div><footer>&copy; me</footer></body></html>"


def test_main_text():
    page = PAGE.format(body="<article><header><h1>Title &amp; more</h1></header><p>One<br>two\n <b>three<p>Four<ul><li>a<li>b</ul><div class='advert'>Buy</div></article>")
    assert html_extract.main_text(page) == "Title & more\nOne two three\nFour\na\nb"
    assert html_extract.main_text("<p>x<script>1</script>y<style>z") == "xy"


def test_site_styles_remove_repeated_branches(spark):
    pages = [(k, "http://site.example/a", PAGE.format(body=f"<div class='story'><p>Story number {k} is about {k * 7}.</p></div>")) for k in range(12)]
    found = html_extract.extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {k: f"Story number {k} is about {k * 7}." for k in range(12)}


def test_copies_of_an_article_stay(spark):
    pages = [(k, "http://site.example/a", PAGE.format(body="<article><p>The same article.</p></article>")) for k in range(12)]
    assert {r["text"] for r in html_extract.extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()} == {"The same article."}


def test_unique_pages_among_copies_stay(spark):
    """Pages without a marked article: 38 copies of one text, a page of its own, and a small host with a template."""
    page = "<html><body>{}</body></html>"
    text = lambda name: "\n".join(f"{name} paragraph {k} of some length." for k in range(3))
    html = lambda t: page.format("".join(f"<p>{x}</p>" for x in t.split("\n")))
    rows = [(k, "http://site.example/a", html(text("Copied"))) for k in range(38)] + [(38, "http://site.example/b", html(text("Unique")))]
    rows += [(k, "http://small.example/", page.format(f"<div class='box'>On every page</div><p>The story of number {k} is long.</p>")) for k in (50, 51, 52)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found[38] == text("Unique") and {found[k] for k in range(38)} == {text("Copied")}
    assert [found[k] for k in (50, 51, 52)] == [f"The story of number {k} is long." for k in (50, 51, 52)]


def test_lines(spark):
    rng = random.Random(4)
    line = " ".join(f"token{rng.randrange(10_000)}" for _ in range(150))
    near = line.replace(line.split()[70], "changed")
    rows = [(1, f"{line}\nshort one"), (2, f"other words here entirely different\n{near}"), (3, f"SHORT  one!\n{line.upper()}."), (4, "---\n---")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: rows[0][1], 2: "other words here entirely different", 3: "", 4: "---\n---"}


def test_lines_between_two_alike_ones(spark):
    """Lines of the same words in other orders share every block but aren't alike; they don't part two lines that are."""
    rng = random.Random(6)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)]
    lines = [" ".join(words)] + [" ".join(rng.sample(words, 40)) for _ in range(30)] + [" ".join([words[1], words[0], *words[2:]])]
    found = line_dedup.deduplicated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in found if r["n_removed"]} == {31}


def test_fuzzy_lines_of_any_length(spark):
    """A fifth of the words changed in few characters, or one word replaced: all are within the stated similarity."""
    rng, lines = random.Random(8), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9)))
    for n in [5, 6, 7, 8, 10, 12, 15, 16, 20, 40, 80, 150]:
        first = [word() for _ in range(n)]
        typos, replaced = list(first), list(first)
        for k in rng.sample(range(n), max(1, n // 5)):
            typos[k] = "z" + typos[k][1:]
        replaced[n // 2] = "new"
        lines.append(["\n".join(map(" ".join, (first, typos, replaced)))])
    found = line_dedup.deduplicated_lines(spark.createDataFrame([(k, t) for k, [t] in enumerate(lines)], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == dict.fromkeys(range(12), 2)


def test_lines_that_differ_in_digits(spark):
    lines = ["1024", "7777", "Tel 555 1234", "Tel 888 9876", "11 22 33 44 55 66", "77 88 99 10 20 30", "Tel: 555-1234"]
    found = line_dedup.deduplicated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in found if r["n_removed"]} == {6}


def test_lines_of_documents_without_an_id(spark):
    same, near = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine tin"
    rows = [(None, f"{same}\nfirst only here"), (None, f"other text\n{same}"), (None, "plain\nunlike all"), (3, f"kept words\n{near}"), (4, "a\nb"), (4, "c\nb")]
    found = line_dedup.deduplicated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    left = sorted(x for r in found for x in r["text"].split("\n") if x)
    assert left == sorted(["first only here", "other text", "plain", "unlike all", "kept words", "a", "b", "c", same])


def test_exact_lines_against_brute_force(spark):
    documents = table(spark, "documents")
    found = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated_lines(documents).collect()}
    seen, letters = set(), re.compile(r"[^\W_]")
    for row in sorted(documents.collect(), key=lambda r: r["doc_id"]):
        kept = set(found[row["doc_id"]].split("\n"))
        for line in row["text"].split("\n"):
            if letters.search(line):
                assert line in kept or line_key(line) in seen or len(line.split()) >= line_dedup.MIN_WORDS
                if line in kept:
                    seen.add(line_key(line))


def line_key(line):
    return re.sub(r"\d", "0", re.sub(r"[\W_]+", " ", line.lower())).strip()


def test_pipeline_runs_its_stages(spark, tmp_path):
    import corpus_pipeline

    table(spark, "documents").limit(60).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) and {"doc_id", "text", "token_ids", "n_tokens"} <= set(out.columns)
    assert out["doc_id"].value_counts().max() <= mixing.MAX_COPIES
    own = sentencepiece_wfst.Transducer.load()
    assert all(own.encode(t) == list(i) for t, i in zip(out["text"], out["token_ids"], strict=True))
    assert isinstance(out, pd.DataFrame)
