"""The training-data operators on small cases and against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grovewise.llm.contamination import best_stretch, leaks, normal_words, short_items, without_leaks, words_of
from grovewise.llm.linkage import LinkSettings, candidate_pairs, fit, link, one_to_one, survey_shifts
from grovewise.llm.packing import CAPACITY, fill_report, pack, packed_documents, sweep, token_counts
from grovewise.llm.percentiles import combine, exact_percentiles, summaries
from grovewise.llm.subjects import composition, sentences, subjects_of, train

# -- percentiles -----------------------------------------------------------------


def _values(seed=0):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(3000) < 0.4, "hot", rng.integers(0, 30, 3000).astype(str))
    v = np.round(rng.normal(5, 3, 3000), 1)
    return pd.DataFrame({"id": np.arange(3000), "g": g, "v": v, "day": rng.integers(0, 5, 3000)})


@pytest.mark.parametrize("most", [500_000, 10])
def test_percentiles_are_those_of_numpy(spark, most):
    pdf = _values()
    df = spark.createDataFrame(pd.concat([pdf, pdf.head(500)])).withColumn("value", F.lit("clash")).withColumn("_n", F.lit(1))
    got = exact_percentiles(df, ["g"], ["v"], [0, 12.5, 50, 95, 100], item="id", broadcast_rows=most).toPandas()
    assert len(got) == 5 * pdf.g.nunique()
    for r in got.itertuples():
        own = pdf[pdf.g == r.g].v
        assert r.value == pytest.approx(np.percentile(own, r.pct), abs=1e-9) and r.n == len(own)


def test_percentiles_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 4.0), (None, 1.0), (None, 2.0), ("a", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["value"]) for r in exact_percentiles(df, ["g"], ["v"], [50]).collect()}
    assert got == {"b": (1, 4.0), None: (2, 1.5)}
    assert exact_percentiles(df.limit(0), ["g"], ["v"], [50]).count() == 0
    with pytest.raises(ValueError):
        exact_percentiles(df, ["g"], ["v"], [101])


def test_combined_summaries_keep_the_error_bound(spark):
    pdf = _values(1)
    got = combine(summaries(spark.createDataFrame(pdf), ["g"], "day", ["v"], 0.02, item="id"), ["g"], [5, 50, 95]).toPandas()
    for r in got.itertuples():
        own = np.sort(pdf[pdf.g == r.g].v.to_numpy())
        assert r.n == len(own)
        want = math.floor((len(own) - 1) * r.pct / 100)
        low, high = np.searchsorted(own, r.value, "left"), np.searchsorted(own, r.value, "right") - 1
        assert low - (0.02 * len(own) + 5) <= want <= high + 0.02 * len(own) + 5
    assert len(got) == 3 * pdf.g.nunique()


# -- linkage ---------------------------------------------------------------------


def _plot(spark, shift=(3.0, -2.0), n=80, seed=3):
    rng = np.random.default_rng(seed)
    a = pd.DataFrame({"a_id": np.arange(n), "cloud": 1, "a_x": rng.uniform(0, 50, n), "a_y": rng.uniform(0, 50, n), "a_height": rng.uniform(5, 30, n), "a_dbh": rng.uniform(0.05, 0.8, n), "a_fit": 0.05})
    kept = rng.permutation(n)[: n - 15]
    b = pd.DataFrame({"b_id": 1000 + kept, "cloud": 1, "b_x": a.a_x[kept] + shift[0] + rng.normal(0, 0.25, len(kept)), "b_y": a.a_y[kept] + shift[1] + rng.normal(0, 0.25, len(kept)), "b_height": a.a_height[kept] + rng.normal(0, 0.4, len(kept)), "b_dbh": a.a_dbh[kept] * np.exp(rng.normal(0, 0.04, len(kept)))})
    ghosts = pd.DataFrame({"b_id": 5000 + np.arange(10), "cloud": 1, "b_x": rng.uniform(0, 50, 10), "b_y": rng.uniform(0, 50, 10), "b_height": rng.uniform(5, 30, 10), "b_dbh": rng.uniform(0.05, 0.8, 10)})
    return spark.createDataFrame(a), spark.createDataFrame(pd.concat([b, ghosts]))


def test_links_find_the_true_pairs(spark):
    a, b = _plot(spark)
    s = survey_shifts(a, b).first()
    assert abs(s["dx"] - 3.0) < 0.2 and abs(s["dy"] + 2.0) < 0.2
    got = link(a, b).collect()
    assert len({r["a_id"] for r in got}) == len(got) == len({r["b_id"] for r in got})
    right = sum(r["b_id"] == 1000 + r["a_id"] for r in got)
    assert right >= 62 and len(got) - right <= 3
    assert all(0.5 <= r["confidence"] <= 1 for r in got)


def test_links_with_nulls_and_empty_sides(spark):
    a, b = _plot(spark, n=40)
    none = {c: None for c in b.columns} | {"b_id": 9999, "cloud": 1}
    b2 = b.unionByName(spark.createDataFrame([none], b.schema))
    assert link(a, b2).count() >= 20
    assert link(a.limit(0), b).count() == 0 and link(a, b.limit(0)).count() == 0


def test_blocking_loses_no_near_pair(spark):
    a, b = _plot(spark, shift=(0.0, 0.0))
    s = LinkSettings()
    pa_, pb = a.toPandas(), b.toPandas()
    near = {(x.a_id, y.b_id) for x in pa_.itertuples() for y in pb.itertuples() if math.hypot(x.a_x - y.b_x, x.a_y - y.b_y) <= s.near}
    got = {(r["a_id"], r["b_id"]) for r in candidate_pairs(a, b, s).collect()}
    assert near <= got and len(got) < len(pa_) * len(pb) / 4


def test_rounds_equal_the_greedy_walk(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = list({(rng.randrange(12), rng.randrange(12)): rng.randrange(4) for _ in range(60)}.items())
        df = spark.createDataFrame([(a, b, w) for (a, b), w in rows], "a_id int, b_id int, w int")
        got = {(r["a_id"], r["b_id"]) for r in one_to_one(df, [F.col("w").alias("w")]).collect()}
        want, used_a, used_b = set(), set(), set()
        for (a, b), _ in sorted(rows, key=lambda r: (r[1], *r[0])):
            if a not in used_a and b not in used_b:
                want.add((a, b)), used_a.add(a), used_b.add(b)
        assert got == want


def test_expectation_maximisation_separates_patterns():
    patterns = [((0, 0), 80), ((0, 1), 20), ((1, 0), 15), ((2, 2), 700), ((1, 2), 150), ((2, 1), 150), ((-1, 0), 5)]
    p, m, u = fit(patterns, (3, 3))
    assert 0.05 < p < 0.2 and m[0][0] > u[0][0] and u[1][2] > m[1][2]
    assert fit([], (3, 3))[0] == 0.3


# -- packing ---------------------------------------------------------------------


def _best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= s]
        if fits:
            i = min(fits, key=lambda i: gaps[i])
            gaps[i] -= s
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


def test_sweep_equals_one_by_one_best_fit():
    rng = random.Random(1)
    for capacity in (10, 37, 100):
        for _ in range(30):
            sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
            counts = {s: sizes.count(s) for s in set(sizes)}
            used: dict[int, int] = {}
            placed = 0
            for size, rank, n, start, each in sweep(counts, capacity):
                for k in range(n):
                    used[start + k // each] = used.get(start + k // each, 0) + size
                placed += n
            assert placed == len(sizes) and sorted(capacity - v for v in used.values()) == _best_fit(sizes, capacity)


def test_pack_keeps_items_whole(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([7, 64, 500, rng.randint(1, 2048)])) for i in range(600)] + [(1000, 5000), (1001, 2048), (1002, 0), (1003, None), (1004, 4096), (5, 64)]
    got = pack(spark.createDataFrame(items, "id int, size int").withColumn("container", F.lit("clash")), "id", "size").toPandas()
    assert got.groupby("container")["size"].sum().max() <= CAPACITY
    want = {i: s for i, s in items if s is not None}
    assert got[got.id != 5].groupby("id")["size"].sum().to_dict() == {k: v for k, v in want.items() if k != 5} and (got.id == 5).sum() == 2
    assert got[got.piece > 0].id.unique().tolist() == [1000, 1004] or set(got[got.piece > 0].id) == {1000, 1004}
    assert got[got.id == 1000].sort_values("piece")["size"].tolist() == [2048, 2048, 904]
    report = fill_report(pack(spark.createDataFrame(items, "id int, size int"), "id", "size")).first()
    assert report["fullest"] <= CAPACITY and report["unused"] < 0.05
    assert pack(spark.createDataFrame([], "id int, size int"), "id", "size").count() == 0


def test_tokens_of_whole_texts(spark):
    long = "The tree grows by the river. " * 60_000
    df = spark.createDataFrame([(1, "a tree"), (2, ""), (3, None), (4, long), (5, "<|endoftext|>"), (6, "x" * 300_000)], "doc_id int, text string")
    got = {r["doc_id"]: r["tokens"] for r in token_counts(df, "text").select("doc_id", "tokens").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] is None and got[5] > 1 and got[6] > 1000
    assert abs(got[4] - 7 * 60_000) <= 60_000
    packed = packed_documents(df).toPandas()
    assert set(packed[packed.piece > 0].doc_id) == {4, 6} and packed[packed.doc_id == 4]["size"].sum() == got[4]


# -- contamination ---------------------------------------------------------------

PASSAGE = "Because nobody at Jinaridge kept notes, seed caches rose to 803 as larval galleries sank to 173, which Wanilpan later denied after the upper-stem count."


def _apart(a, b):
    row = list(range(len(b) + 1))
    for i, w in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != d)))
        row = new
    return row[-1]


def _slow(item, doc, stretch=14, one_in=8):
    """Whether any stretch of the item, its ends held, aligns with any span of the document with few enough errors (edit distance by definition)."""
    for i in range(len(item)):
        for j in range(i + stretch, len(item) + 1):
            for p in (p for p, d in enumerate(doc) if d == item[i]):
                for q in (q for q, d in enumerate(doc) if d == item[j - 1] and q > p):
                    if _apart(item[i + 1 : j - 1], doc[p + 1 : q]) <= (j - i) // one_in:
                        return True
    return False


def test_stretches_against_edit_distance():
    rng = random.Random(3)
    seen = [0, 0]
    for _ in range(150):
        item = [rng.randrange(60) for _ in range(rng.randint(14, 24))]
        doc = item[rng.randrange(5) : len(item) - rng.randrange(5)]
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(doc))
            doc = rng.choice([doc[:k] + [99] + doc[k:], doc[:k] + doc[k + 1 :], doc[:k] + [98] + doc[k + 1 :]])
        doc = [77] * 3 + doc + [76] * 3
        got = best_stretch(item, np.array(doc)) is not None
        seen[got] += 1
        assert got == _slow(item, doc)
    assert min(seen) > 15


def test_leaks_in_all_disguises(spark):
    words = PASSAGE.split()
    changed = words.copy()
    changed[7] = "nothing"
    docs = {
        1: "Intro. " + PASSAGE + " End.", 2: PASSAGE.upper().replace(",", ""), 3: "<p>" + " ".join(f"<b>{w}</b>" if i % 3 == 0 else w for i, w in enumerate(words)) + "</p>", 4: PASSAGE.replace("Jinaridge", "Jina-\nridge").replace(" as ", "\n> as "),
        5: "x " + " ".join(words[:14]) + " y", 6: "x " + " ".join(words[:13]) + " y", 7: " ".join(changed), 8: " ".join(w if i % 4 else "zap" for i, w in enumerate(words)), 9: "", 10: None, 11: "a " * 200_000 + PASSAGE, 12: PASSAGE.replace("upper-stem", "upper-\nstem").replace("Because nobody at Jinaridge kept notes, seed", ""),
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id int, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, PASSAGE), (2, "too short"), (3, None), (4, "An altogether different sentence that nobody has ever put into any of these documents, as far as known.")], "item_id int, passage string")
    got = leaks(df, items)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(d, 1) for d in (1, 2, 3, 4, 5, 7, 11, 12)]
    assert sorted(r["doc_id"] for r in without_leaks(df, got).collect()) == [6, 8, 9, 10]
    cut = {r["doc_id"]: r["text"] for r in without_leaks(df, got, whole=False).collect()}
    assert cut[6] == docs[6] and "jinaridge" not in cut[1] and cut[1].startswith("intro") and cut[10] is None
    assert leaks(df.limit(0), items).count() == 0 and leaks(df, items.limit(0)).count() == 0


def test_leaks_of_repeated_words_and_repeated_passages(spark):
    few = "a b a b a c a b a b a c a b a b a"
    long = " ".join(f"w{i % 97}x{i % 31}" for i in range(400))
    docs = {1: "so " + few + " it is", 2: "one " + PASSAGE + " two " + PASSAGE.upper() + " three", 3: " ".join([PASSAGE] * 300), 4: long + " and " + long, 5: "a b a b a c a b a"}
    df = spark.createDataFrame([*docs.items(), (1, docs[1])], "doc_id long, text string")
    items = spark.createDataFrame([("few", few), ("p", PASSAGE), ("again", PASSAGE.lower()), ("long", long), ("short", "under fourteen words"), ("none", None), ("few", few)], "item_id string, passage string")
    got = leaks(df, items)
    rows = got.toPandas()
    assert {(d, i) for d, i in zip(rows.doc_id, rows.item_id)} == {(1, "few"), (2, "p"), (2, "again"), (3, "p"), (3, "again"), (4, "long")}
    size = len(words_of(PASSAGE))
    assert sorted(rows[(rows.doc_id == 2) & (rows.item_id == "p")].first_word) == [1, size + 2]
    assert len(rows[(rows.doc_id == 3) & (rows.item_id == "p")]) == 300 and sorted(rows[rows.doc_id == 4].words) == [400, 400]
    cut = {r["doc_id"]: r["text"] for r in without_leaks(df.filter("doc_id > 1"), got, whole=False).collect()}
    assert cut == {2: "one two three", 3: "", 4: "and", 5: docs[5]}
    assert sorted((r["item_id"], r["words"]) for r in short_items(items).collect()) == [("none", 0), ("short", 3)]
    with pytest.raises(ValueError):
        leaks(df, items, n=6)


def test_blocks_of_passages_and_slices_of_texts_change_nothing(spark, monkeypatch):
    from grovewise.llm import contamination

    rng = random.Random(9)
    passages = [" ".join(rng.choice("oak elm fir ash yew bay box fig".split()) for _ in range(30)) for _ in range(12)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string")
    df = spark.createDataFrame([(i, "x " + " ".join(rng.sample(passages, 3)) + " y") for i in range(40)], "doc_id int, text string")
    whole = sorted(map(tuple, leaks(df, items).collect()))
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 300)
    assert sorted(map(tuple, leaks(df, items).collect())) == whole and len(whole) >= 120
    tests = contamination.TestSet.of(list(enumerate(passages)), 5, 14)
    words, owner = contamination.hashed([r["text"] for r in df.collect()])
    at_once = contamination._stretches(tests, words, owner, 14, 8).tolist()
    monkeypatch.setattr(contamination, "SLICE_HITS", 50)
    assert contamination._stretches(tests, words, owner, 14, 8).tolist() == at_once


def test_words_without_markup(spark):
    one = spark.createDataFrame([("A&nbsp;tree&#39;s <em>up</em>per-stem<br>is  wide，very.",), (None,)], "t string").select(normal_words(F.col("t"))).collect()
    assert one[0][0] == ["a", "trees", "upperstem", "is", "wide", "very"] and one[1][0] == []


# -- subjects --------------------------------------------------------------------

TOPICS = {"law": ("tribunal lease clause appeal permit tenure".split(), "upholds grants revokes limits".split()), "sport": ("relay pitch goal team league coach".split(), "scores wins trains loses".split()), "lidar": ("scanner echo pulse strip tripod return".split(), "drifts records splits thins".split())}


def _sentence(rng, topic):
    nouns, verbs = TOPICS[topic]
    return f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} on day {rng.randrange(90)}."


def test_subjects_of_held_out_texts(spark):
    rng = random.Random(4)
    examples = [(t, " ".join(_sentence(rng, t) for _ in range(4))) for t in TOPICS for _ in range(20)]
    docs, truth = [], {}
    for i in range(150):
        main, other = rng.sample(list(TOPICS), 2)
        n = rng.choice([0, 1, 3])
        parts = [_sentence(rng, main) for _ in range(7)] + [_sentence(rng, other) for _ in range(n)] + ["More on that below."] * 2
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), "club bulletin"))
        truth[i] = {main} | ({other} if n / len(parts) >= 0.2 else set())
    docs += [(900, "", "x"), (901, None, None), (902, "More on that below. The rest can wait.", "x")]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string").withColumn("subject", F.lit("clash"))
    found = subjects_of(df, spark.createDataFrame(examples, "subject string, text string"))
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.97 * len(truth) and not {900, 901, 902} & set(got)
    parts = {r["subject"]: r["documents"] for r in composition(found, df).collect()}
    assert parts["none"] == 3
    assert subjects_of(df.limit(0), spark.createDataFrame(examples, "subject string, text string")).count() == 0


def test_sentences_and_training():
    assert sentences("Wir waren am 47. noch dort. Das <b>Ende</b>.\n\n- Ein Punkt.\n- Zwei Punkte.") == ["Wir waren am 47. noch dort.", "Das  Ende .", "Ein Punkt.", "Zwei Punkte."]
    assert sentences("") == [] and sentences("one. two words here. ") == ["two words here. "]
    with pytest.raises(ValueError):
        train([])
