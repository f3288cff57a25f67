import random

import pytest
from pyspark.sql import functions as F

from engram.llm import common, decontaminate, langid, line_dedup, ngram_join, pii, quality_model, quality_rules

from .cases import PROSE, documents


def text_table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# Near duplicates.


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_links(texts, threshold=0.8):
    sets = [shingle_set(t) for t in texts]
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= threshold * len(a | b)}


@pytest.mark.parametrize("cell", [1000, 7])
def test_near_duplicates_match_brute_force(spark, cell):
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(9999)}" for _ in range(120)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(copy))
        texts += [" ".join(base)] * 3
    texts += [None, "", "short one", "Short  ONE"]
    links = brute_links(texts)
    got = {r["doc_id"]: r for r in ngram_join.join_similar(text_table(spark, texts), cell=cell).collect()}
    # Banding finds a pair at the threshold with a chance of 0.9999; pairs of one group are all compared.
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(a == i for a, _ in links) for i in range(len(texts))}
    near = {i: {i} for i in range(len(texts))}
    for a, b in links:
        merged = near[a] | near[b]
        for x in merged:
            near[x] = merged
    assert {i: r["class_id"] for i, r in got.items()} == {i: min(s) for i, s in near.items()}


def test_near_duplicates_of_awkward_rows(spark):
    got = ngram_join.join_similar(documents(spark)).collect()
    assert len(got) == 14
    by = {(r["doc_id"], r["n_shingles"]): (r["class_id"], r["n_links"]) for r in got}
    assert by[1, 23] == by[2, 23] == by[3, 23] == (1, 3)
    assert by[7, 1] == by[8, 1] == (7, 1)
    assert by[4, 0] == (4, 0) and by[5, 0] == (5, 0)
    assert ngram_join.join_similar(empty(spark)).count() == 0
    assert ngram_join.recall(0.8) > 0.999


def test_near_duplicates_without_or_with_equal_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a + " other"), (None, "some words of no other row at all")]
    got = ngram_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["class_id"] or 0, r["n_links"]) for r in got)
    # Two classes of id 1, told apart by their numbers: A with 2 and a row without an id, B with 3.
    assert found == [(0, 0), (1, 1), (1, 1), (1, 2), (1, 2), (1, 2)]
    assert len({r["class"] for r in got}) == 3


def test_results_do_not_depend_on_broadcasts(spark, data, monkeypatch):
    """Beyond the counted sizes joins shuffle; the rows are the same."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    near = lambda: sorted(map(tuple, ngram_join.join_similar(docs).drop("class").collect()))
    lines = lambda: sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))
    before = near(), lines()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_RANGES", 0)
    assert (near(), lines()) == before


def test_near_duplicates_of_chained_documents(spark):
    # Each is similar to its neighbours only, so one class needs many rounds, and no two others may be linked.
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[4 * i : 4 * i + 100]) for i in range(60)]
    links = brute_links(texts)
    got = {r["doc_id"]: r for r in ngram_join.join_similar(text_table(spark, texts), cell=5).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(x == i for x, _ in links) for i in range(60)}
    assert {r["class_id"] for r in got.values()} == {0}


def test_components_with_a_hot_node(spark):
    from engram.llm.components import components

    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1050)] + [(5, 5), (2000, 2000)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(400)} | {i: 1000 for i in range(1000, 1051)}


# Line dedup.


def brute_dedup(rows, enough=None):
    first, gone = {}, {}
    for key, text in rows:
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.split()]
        for s, i in enumerate(full):
            take, n = None, 0
            for k in range(3):
                if s + k >= len(full):
                    break
                n += len(lines[full[s + k]].split())
                if (enough is not None and n > enough) or k == 2:
                    take = k + 1
                    break
            if take is None:
                continue
            end = full[s + take] if s + take < len(full) else len(lines)
            window = tuple(lines[j] for j in full[s : s + take])
            if window in first:
                doc, after = first[window]
                gone.setdefault(key, set()).update(range(max(i, after) if doc == key else i, end))
            else:
                first[window] = key, end
    return {key: text if key not in gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[key]) for key, text in rows}


@pytest.mark.parametrize("enough", [None, 50])
def test_line_dedup_matches_brute_force(spark, enough):
    rng = random.Random(5)
    pool = [f"line {i} " + "word " * rng.choice([1, 3, 20, 60]) for i in range(6)] + ["", "  "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 15))) for _ in range(80)] + [None, "", "a\n" * 6, "thanks", "thanks"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(text_table(spark, texts), enough=enough).collect()}
    assert got == brute_dedup(list(enumerate(texts)), enough)
    if enough is None:
        assert got[82] == "a\na\na" and got[84] == "thanks"


def test_frequent_windows_are_matched_by_a_broadcast(spark):
    notice = "one line\nand another\nand a third"
    texts = [f"{notice}\nown line {i}" for i in range(400)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(text_table(spark, texts)).collect()}
    assert got == {i: t if i == 0 else f"own line {i}" for i, t in enumerate(texts)}


def test_line_dedup_of_awkward_rows(spark):
    docs = documents(spark).drop("n_lines", "n_removed")
    out = line_dedup.dedup_lines(docs, enough=20)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == 14
    by = {(r["doc_id"], r["n_removed"] > 0) for r in out.collect()}
    assert (1, False) in by and (2, True) in by and (4, False) in by
    # By default documents of fewer than three lines have no window.
    assert {r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()} == {0}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# Decontamination.


def test_contained_items_are_found(spark):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in (5, 6, 9, 12, 20, 33, 60, 130, 300)]
    texts, planted = [], set()
    for d in range(60):
        body = [word() for _ in range(rng.choice([0, 40, 400, 3000]))]
        for _ in range(rng.randrange(0, 3)):
            i = rng.randrange(len(items))
            at = rng.randrange(len(body) + 1)
            body[at:at] = items[i]
        texts.append(" ".join(body).title())
    sets = [shingle_set(" ".join(i)) for i in items]
    for d, t in enumerate(texts):
        own = shingle_set(t)
        planted |= {(d, i) for i, s in enumerate(sets) if len(s & own) >= 0.8 * len(s)}
    few = {90 + k: items[3][2 : 2 + k] for k in range(1, 5)}
    planted |= {(d, i) for i, x in few.items() for d, t in enumerate(texts) if f" {' '.join(x)} " in f" {t.lower()} "}
    assert {i for _, i in planted} >= set(few)
    texts += [" ".join(few[94]), None]
    planted |= {(60, i) for i in few}
    asked = [(i, " ".join(x)) for i, x in [*enumerate(items), *few.items()]] + [(80, None), (81, " ")]
    asked = spark.createDataFrame(asked, "item_id long, text string")
    for block in (1_000_000, 40):
        docs = text_table(spark, texts)
        got = decontaminate.find_contained(docs, asked, block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == planted and len(got) == len(planted)
        kept = decontaminate.without_contained(docs, asked, block=block)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(62)) - {d for d, _ in planted})


def test_decontamination_of_awkward_rows(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.find_contained(docs, items).collect()) == [1, 1, 2, 3]
    out = decontaminate.without_contained(docs, items)
    assert out.columns == docs.columns and out.count() == 10
    assert decontaminate.find_contained(docs, items.limit(0)).count() == 0
    assert decontaminate.find_contained(empty(spark), items).count() == 0
    assert decontaminate.values_needed(0.8, 1e-5) > 40


# Quality rules.


def test_statistics_match_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(documents(spark).select("doc_id", "text"))
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((r["doc_id"], *(r[n] for n in names)) for r in quality_rules.text_statistics(docs).collect() if r["doc_id"] is not None)
    assert got == sorted((i, *quality_rules.brute_force(t)) for i, t in texts if i is not None)


def test_rules_are_learned_and_applied(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        bad = i % 5 == 0
        rows.append({"y": 0 if bad else 1, "n_words": rng.uniform(20, 500), "mean_word": rng.uniform(3, 6), "symbols": rng.uniform(0.1, 0.3) if bad else rng.uniform(0, 0.05), "dup_lines": rng.random() * 0.1, "repeats": 0.0, "line_words": rng.uniform(5, 60)})
    rules = quality_rules.learn_rules(rows)
    assert rules and all(r.tests for r in rules)
    hit = [any(rule.fits(r) for rule in rules) for r in rows]
    assert sum(h for h, r in zip(hit, rows) if r["y"]) <= 0.02 * len(rows) and sum(h for h, r in zip(hit, rows) if not r["y"]) > 0.9 * 180
    assert quality_rules.learn_rules([]) == [] and quality_rules.learn_rules([r for r in rows if r["y"]]) == []
    judged = quality_rules.judge_quality(documents(spark), rules)
    assert judged.count() == 14 and judged.filter("base_failed and kept").count() == 0
    assert quality_rules.judge_quality(empty(spark), []).count() == 0


def test_decision_list_matches_rules(spark, data):
    """What Spark keeps is what the rules keep, tried one by one on features computed here."""
    rules = [
        quality_rules.Rule([("symbols", ">", 0.02), ("n_words", "<=", 400.0)]),
        quality_rules.Rule([("mean_word", "<=", 4.2), ("dup_lines", "<=", 0.0), ("line_words", ">", 20.5)]),
        quality_rules.Rule([("repeats", ">", 0.01)]),
    ]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text").filter("doc_id > 3").withColumn("doc_id", F.col("doc_id") + 10**6))
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge_quality(docs, rules).collect()}
    want = {}
    for doc_id, text in docs.collect():
        n, chars, symbols, dup, repeat = quality_rules.brute_force(text)
        lines = max(sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n")), 1)
        row = {"n_words": n, "mean_word": chars / max(n, 1), "symbols": symbols / max(chars, 1), "dup_lines": dup / lines, "repeats": repeat / max(n, 1), "line_words": n / lines}
        failed = n < 20 or 100 * repeat > 30 * n
        want[doc_id] = failed, not failed and not any(rule.fits(row) for rule in rules)
    assert got == want and len(set(got.values())) == 3


def test_an_imprecise_rule_makes_way_for_others():
    rng = random.Random(4)
    # Long words tell most of the low quality among the rows that grow rules, but not among those held back; many symbols tell some of it.
    rows = []
    for i in range(1200):
        y = int(i % 4 != 1)
        rows.append({f: rng.random() for f in quality_rules.FEATURES} | {"y": y, "mean_word": float(y == 0) if i % 3 else rng.random(), "symbols": 0.0})
    for i, r in enumerate(rows):
        if not r["y"] and i % 8 == 1:
            r["symbols"] = 5.0
    rules = quality_rules.learn_rules(rows)
    assert any(f == "symbols" for r in rules for f, _, _ in r.tests) and all(f != "mean_word" for r in rules for f, _, _ in r.tests[:1])


# Quality model.


def test_quality_model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    weights = quality_model.fit(docs, labels.filter(~quality_model.held_out()))
    scored = quality_model.score_quality(docs.unionByName(documents(spark).select("doc_id", "text")), weights)
    rows = scored.collect()
    assert len(rows) == docs.count() + 14 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    both = scored.join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("s")).collect()
    means = {r["quality"]: r["s"] for r in both}
    assert means[1] > means[0] + 0.2


def test_quality_held_out_accuracy(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    out = quality_model.op9_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    held = out.filter("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert held["a"] > 0.9 and held["n"] > 50


def test_quality_scores_match_brute_force(spark, data):
    import numpy as np

    from engram.llm.shingles import WordHasher

    weights = np.random.RandomState(3).normal(size=(1 << 12) + 1).astype(np.float32)
    texts = ["one two two three", "", None, " ", "a", "Ä b\tb  c", "word " * 200_000]
    hasher = WordHasher()
    want = []
    for t in texts:
        w = (t or "").lower().split()
        h = [int(hasher.words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0][0]) for x in (dict.fromkeys(w))]
        of, top = dict(zip(dict.fromkeys(w), h)), (1 << 64) - 1
        at = [(of[x] * int(quality_model.MIX) & top) >> 52 for x in w]
        for x, y in zip(w, w[1:]):
            pair = int(quality_model.PAIR) if x == y else (of[x] * int(quality_model.PAIR) + of[y]) & top
            at.append((pair * int(quality_model.MIX) & top) >> 52)
        z = float(weights[-1]) + sum(float(weights[i]) for i in at) / max(len(at), 1) ** 0.5
        want.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
    got = {r["doc_id"]: r["score"] for r in quality_model.score_quality(text_table(spark, texts), weights).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want)


def test_word_hashes_do_not_depend_on_chunks():
    import numpy as np
    import pyarrow as pa

    from engram.llm import shingles

    texts = ["aa b", None, "", "  b\taa ", "x" * (shingles.PIECE + 10) + " aa", "b " * 200_000]
    hasher, whole = shingles.WordHasher(), {}
    for most in (3, 1_500_000, 1 << 30):
        found = {}
        for a, b, words, offsets in hasher.chunks(pa.array(texts), most):
            for i in range(a, b):
                found[i] = words[offsets[i - a] : offsets[i - a + 1]].tolist()
        whole = whole or found
        assert found == whole
    assert [len(whole[i]) for i in range(6)] == [2, 0, 0, 2, 2, 200_000]
    assert whole[0] == whole[3][::-1] and whole[4][1] == whole[0][0] and set(whole[5]) == {whole[0][1]}
    assert isinstance(hasher.of_byte, np.ndarray)


def test_quality_model_without_labels(spark):
    docs = empty(spark)
    weights = quality_model.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_model.score_quality(documents(spark), weights).collect()} == {0.5}
    assert quality_model.score_quality(docs, weights).count() == 0


# Language.


def test_language_accuracy(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    out = langid.op10_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()["a"]
    assert held > 0.97


def test_language_of_awkward_rows(spark):
    docs = documents(spark)
    known = langid.learn(docs, least=1)
    rows = langid.predict_language(docs, known).collect()
    assert len(rows) == 14
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {4, 5, 6}
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {"en", "fr", "de", "und"} for r in rows)
    none = langid.learn(empty(spark))
    assert {r["lang_pred"] for r in langid.predict_language(docs, none).collect()} == {"und"}
    assert langid.predict_language(empty(spark), known).count() == 0


def test_filter_never_forgets():
    import numpy as np

    f = langid.Filter([f"l{k:03}" for k in range(130)], "l000", 12, 3)
    assert len(f.tables) == 3
    grams = np.random.RandomState(1).randint(1, 2**62, 300).astype(np.uint64)
    f.add(0, grams[:200])
    f.add(129, grams[100:])
    f.finish()
    masks = f.masks(grams)
    assert f.bit(masks[0], 0)[:200].all() and f.bit(masks[2], 129)[100:].all() and (f.false < 0.2).all()


def test_many_languages_and_rare_ones(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    # Seventy languages, each of words of its own; the last has three documents among thousands.
    lexicon = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(7)) for _ in range(30)] for k in range(70)}
    rows = [(lang, " ".join(rng.choice(own) for _ in range(30))) for lang, own in lexicon.items() for _ in range(3 if lang == "l69" else 40)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    known = langid.learn(docs, sample=20)
    assert known.langs == sorted(lexicon)
    out = langid.predict_language(docs, known).join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.99 * len(out)
    assert all(r["lang_pred"] == "l69" for r in out if r["lang"] == "l69")


def brute_language(known, text):
    """The prediction for one text, n-gram by n-gram."""
    import numpy as np

    words = "".join(c if c.isalpha() else " " for c in text.lower())
    counts, n = [0.0] * len(known.langs), 0
    if not words.strip():
        return "und"
    padded = "\0" + words.replace(" ", "\0") + "\0\0"
    for size in langid.GRAM_SIZES:
        for i in range(len(padded) - size + 1):
            gram = padded[i : i + size]
            if "\0" in gram[1:-1]:
                continue
            h = sum((ord(c) if c != "\0" else 0) * int(m) for c, m in zip(gram, langid.MIX)) + size & (1 << 64) - 1
            h = np.array([((h ^ (h >> 29)) * int(langid.MIX[4])) & (1 << 64) - 1], np.uint64)
            masks = known.masks(h)
            n += 1
            for k in range(len(counts)):
                counts[k] += int(known.bit(masks[k // langid.WIDTH], k)[0])
    true = [max(c - n * f, 0) / (1 - f) for c, f in zip(counts, known.false)]
    return known.langs[true.index(max(true))] if max(true) > 0 else known.common


def test_language_matches_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    known = langid.learn(docs.filter(~langid.held_out()))
    texts = {r["doc_id"]: r["text"] for r in docs.filter("length(text) < 1500").limit(40).collect()}
    texts |= {-1: "a", -2: "1 2", -3: "Ünïted", -4: "x-y z"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_language(rows, known).collect()}
    assert got == {i: brute_language(known, t) for i, t in texts.items()}


@pytest.mark.parametrize("name", ["op9", "op10"])
def test_held_out_labels_have_no_effect(spark, data, name, tmp_path):
    import shutil

    folder = tmp_path / "data"
    shutil.copytree(data, folder, ignore=shutil.ignore_patterns("documents*", "labels*"))
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    if name == "op9":
        query, changed = quality_model.op9_quality_classifier, F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))
        labels = labels.withColumn("quality", changed)
    else:
        query, docs = langid.op10_language_id, docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    rows = [sorted(map(tuple, query(spark, str(x)).collect())) for x in (data, folder)]
    assert rows[0] == rows[1] and len(rows[0]) == docs.count()


# Personal data.


def brute_spans(text):
    import re

    def card(m):
        d = [int(c) for c in m if c.isdigit()][::-1]
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", card),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    ]
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_base_spans_match_brute_force(spark, data):
    rng = random.Random(4)
    made = ["".join(rng.choice("ab1259@._+-() é4") for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    made += ["a@b.c_d@e.f 1.2.3.4.5.6.7.8 4111 1111 1111 1111x +1 (988) 555-2485. 999.1.1.1", "1 " * 5000 + "a" * 20000, None, "", "001.002.003.255 4111-1111-1111-1111"]
    texts = made + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: r["base"] for r in pii.find_pii(text_table(spark, texts), []).select("doc_id", pii.written("base").alias("base")).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_secrets_are_added(spark):
    rng = random.Random(9)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [f'words before token = "{h}" and after' for h in hexes] + [f"room {i} of page {i} costs {i}.50 euros at 10:{i % 60:02d}" for i in range(300)]
    docs = text_table(spark, texts)
    out = pii.find_pii(docs).select("doc_id", "n_secret", pii.written("found").alias("f")).collect()
    assert {r["doc_id"] for r in out if r["n_secret"]} == set(range(60))
    assert out[0]["f"] == "secret:22:62"


def test_pii_of_awkward_rows(spark):
    docs = documents(spark)
    assert pii.find_pii(docs).count() == 14
    assert pii.learn_classifier(pii.prepared(empty(spark))) == [] and pii.find_pii(empty(spark), []).count() == 0


@pytest.mark.parametrize("unit", ["k1 ", "1.2.3.4 a9 ", "a" * 50, "1!", "a@b.c "])
def test_pii_time_follows_the_text(spark, unit):
    import time

    spent = []
    for n in (4_000, 40_000):
        docs = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
        spark.range(1).count()
        began = time.perf_counter()
        found = pii.find_pii(docs, [0.0] * 14 + [9.0]).select(F.size("found"), F.size("base")).first()
        spent.append(time.perf_counter() - began)
        assert found[0] == {"k1 ": n, "1.2.3.4 a9 ": 2 * n, "a@b.c ": n}.get(unit, found[0])
    assert spent[1] < 2 + 15 * spent[0] and spent[1] < 12


def test_secrets_match_brute_force(spark, data):
    """The span classifier in plain Python, on the candidates of whole documents."""
    import re

    rng = random.Random(6)
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(150).collect()]
    texts += [" ".join(rng.choice(["AKIA" + "A1B2" * 4, "password=hunter2", "page 12", "x1y2z3w4x5y6z7w8x9", "1.2.3.4", "(9f" + "0a" * 10 + ")", "a@b.org", "é1", "12%"]) for _ in range(12)) for _ in range(60)]
    docs = text_table(spark, texts)
    weights = pii.learn_classifier(pii.prepared(docs))
    blank = r"[^\x20\x09-\x0D]"
    digits = lambda x: sum(c in "0123456789" for c in x)
    want = {}
    for i, text in enumerate(texts):
        base = [tuple(map(int, x.split(":")[1:])) for x in brute_spans(text).split(",") if x]
        secrets = []
        end = 0
        for m in re.finditer(rf"(?<!{blank}){blank}+", text):
            word, gap = m[0], text[end : m.start()]
            if not re.search("[0-9@]", word) and not re.match("A[KS]IA", word):
                continue
            lead = re.match(r"((?:[A-Za-z_-]{1,30}[=:])?[\"'(\[<{]*)", word)[1]
            core = re.sub(r"[\"')\]>},;:!?.#&%$*]+$", "", word[len(lead) :])
            before, end = gap[-24:] + lead, m.end()
            if not core:
                continue
            a, letters = m.start() + len(lead), sum(c.isascii() and c.isalpha() for c in core)
            vote = {
                "shape": 1 if re.search(pii.SHAPE, core) else -1 if re.search(pii.NUMBER, core) else 0,
                "gazetteer": 1 if core.startswith(pii.PREFIXES) else -1 if re.search(pii.LINKS, core) else 0,
                "context": 1 if re.search(pii.BEFORE, before) else -1 if re.search(pii.COUNTED, before) else 0,
                "mix": 1 if len(core) >= 16 and digits(core) >= 4 and letters >= 4 else -1 if len(core) < 8 else 0,
                "words": -1 if re.search("[A-Za-z]{2,}[.,;:!?|]+[A-Za-z]{2,}", core) or not core.isascii() or digits(core) * 5 < len(core) else 0,
            }
            extra = (len(core) >= 12, len(core) >= 20, digits(core) * 2 >= len(core), bool(re.search("^[A-Z0-9]+$", core)))
            x = pii._encode(tuple(vote.values()), extra)
            z = weights[-1] + sum(w * v for w, v in zip(weights, x))
            if z >= 1.3862943611 and not any(s < a + len(core) and e > a for s, e in base):
                secrets.append((a, a + len(core)))
        want[i] = secrets
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"] if s["kind"] == 4] for r in pii.find_pii(docs, weights).collect()}
    assert got == want and sum(map(len, got.values())) > 50
