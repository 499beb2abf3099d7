"""Source divergence, vector codes and quality scores against plain restatements."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from paths import DATA
from pyspark.sql import functions as F

from trawlkit.llm import divergence, quality, vector_codes
from trawlkit.llm.common import table

# Source divergence ------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least=3, term_ranks=200):
    """Rows (lang, source, text) to the audit's rows, straight from the definition."""
    docs = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)) for _, _, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [(d[1], t) for d, t in zip(docs, terms, strict=True) if d[0] == lang]
        seen = Counter(x for _, t in mine for x in set(t))
        kept = sorted(x for x, n in seen.items() if n >= least)
        counts = defaultdict(Counter)
        for source, t in mine:
            counts[source].update(x for x in t if x in set(kept))
        whole = sum(counts.values(), Counter())

        def share(counter, kept=kept):
            n = sum(counter.values())
            return {x: 1 + 10**9 * (counter[x] + 1) // (n + len(kept)) for x in kept}

        q_lang = share(whole)
        p = {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(o, sum((p[s][x] - p[o][x]) ** 2 // p[o][x] for x in kept)) for o in counts if o != s]
            found = [(x, (p[s][x] - q_lang[x]) ** 2 // q_lang[x]) for x in kept if counts[s][x] and p[s][x] > q_lang[x]]
            for part, items, most in (("pair", pairs, None), ("term", found, term_ranks)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def audited(spark, rows, **options):
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    return sorted(tuple(r) for r in divergence.audit(frame, **options).collect())


def test_audit_equals_definition(spark):
    rng = random.Random(3)
    # Long terms with long common beginnings, non-ASCII ones, capitals, terms in two documents only.
    pool = ["a", "Ab", "abc", "straße", "ÄÖ", "äö", "語" * 30, "語" * 30 + "x", "q" * 70, "q" * 70 + "r", "q" * 33, *[f"w{chr(97 + i)}x" for i in range(20)]]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S3", None]), " ".join(rng.choices(pool, k=rng.randint(0, 40)))) for _ in range(80)]
    rows += [("en", "s1", None), ("en", "only-empty", ""), ("xx", "alone", "rare words"), ("en", "digits", "12 34-56")]
    rows += [("en", "s2", "twice twice")] * 2  # two rows, so two documents, still below three
    rows += [("fr", "s1", "z")] * 3  # repeated rows are documents
    assert audited(spark, rows) == plain_audit(rows)


def test_audit_limits_terms_and_breaks_ties_by_bytes(spark):
    words = ["é", "z", "Ω", "b", "a"]
    rows = [("en", "own", " ".join(words))] * 3 + [("en", "other", "common")] * 3
    found = audited(spark, rows, term_ranks=3)
    assert found == plain_audit(rows, term_ranks=3)
    assert [r[3] for r in found if r[1] == "own" and r[2] == "term"] == ["a", "b", "z"]


def test_audit_of_long_and_of_no_texts(spark):
    long = " ".join(f"{'abcdefgh'[i % 8]}{'k' * (i % 50)}" for i in range(200_000))
    rows = [("en", "s1", long), ("en", "s2", long), ("en", "s3", long + " more"), ("en", "s4", "x" * 1_000_000)]
    assert audited(spark, rows) == plain_audit(rows)
    assert audited(spark, []) == []


def test_audit_blocks_and_portions_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("en", f"s{rng.randint(0, 9)}", " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(30))) for _ in range(60)]
    for name, value in (("CELLS", 40), ("SOURCES", 3), ("PORTION", 100), ("MOST_BITS", 32)):
        monkeypatch.setattr(divergence, name, value)
    assert audited(spark, rows) == plain_audit(rows)


def test_rare_extensions_are_not_carried_on(spark):
    rows = [("en", "s", f"{'abcd'}{i:05d}".translate(str.maketrans("0123456789", "ghijklmnop")) + "tail") for i in range(200)] + [("en", "s", "abcdabcdabcd")] * 3
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    kept = divergence.term_counts(docs).collect()
    assert [(r.term, r.n, r.total) for r in kept] == [("abcdabcdabcd", 3, 3)]


def test_shares_are_exact_for_counts_beyond_a_double(spark):
    n, all_n = 987_654_321_987, 9_876_543_210_987_654
    frame = spark.createDataFrame([(n, all_n, 77)], "n long, all_n long, terms long")
    assert frame.select(divergence._share(F.col("n"), F.col("all_n"), F.col("terms"))).first()[0] == 1 + 10**9 * (n + 1) // (all_n + 77)


def test_audit_ignores_other_columns(spark):
    rows = [("en", "s1", "a b", 1), ("en", "s2", "a", 2), ("en", "s2", "a", 2)]
    frame = spark.createDataFrame(rows, "lang string, source string, text string, rank int").withColumns({"value": F.lit("x"), "item": F.lit("y"), "n": F.lit(1), "key": F.lit(2)})
    assert sorted(tuple(r) for r in divergence.audit(frame).collect()) == plain_audit([r[:3] for r in rows])


# Vector codes -----------------------------------------------------------------------------------


def plain_codes(rows, rounds=4, entries=256, parts=4):
    """Full scans in Python integers: {id: (code, error)}, label sums, digest."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[2]))
    width = len(kept[0][2]) // parts
    cut = [[r[2][j * width : (j + 1) * width] for j in range(parts)] for r in kept]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for j in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[nearest(c[j], books[j])[1]].append(c[j])
            for k, xs in members.items():
                books[j][k] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    found = [[nearest(c[j], books[j]) for j in range(parts)] for c in cut]
    out = [(r[0], r[1], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for r, f in zip(kept, found, strict=True)]
    sums = Counter()
    for _, lab, _, e in out:
        sums[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, lab, c, e, sums[lab], digest) for i, lab, c, e in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def coded(spark, rows, **options):
    found, _ = vector_codes.compress(spark.createDataFrame(rows, VECTORS), **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_codes_equal_full_scans(spark):
    rng = np.random.default_rng(1)
    # Coarse components make many equal distances, and equal entries.
    rows = [(int(i), (rng.integers(-3, 4, 8) / 4).tolist(), int(i) % 3 or None) for i in rng.permutation(420)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [None] + [0.0] * 7, 1), (1003, [float("nan")] + [0.0] * 7, 1), (1004, [float("-inf")] + [0.0] * 7, None)]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_few_and_of_repeated_rows(spark):
    rows = [(5, [0.1, -0.2, 0.3, 0.4], None), (5, [0.1, -0.2, 0.3, 0.4], None), (2, [-0.0004, 0.9, 0.0, 0.5], 7), (5, [0.1, -0.2, 0.3, 0.1], None)]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_without_usable_vectors(spark):
    found, books = vector_codes.compress(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert found.count() == 0 and books is None
    assert found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(spark.createDataFrame([], VECTORS))[0].count() == 0


def test_other_lengths_unrepresentable_numbers_and_own_columns_play_no_part(spark):
    rows = [(i, [i / 10, 1.0, 0.5, -0.5], 1) for i in range(9)]
    odd = [(50, [1.0, 2.0], 1), (51, [1e30, 0.0, 0.0, 0.0], 1)]
    frame = spark.createDataFrame(rows + odd, VECTORS).withColumns({"code": F.lit("x"), "x": F.lit(3), "id": F.lit(4), "distance": F.lit(0)})
    assert sorted((tuple(r) for r in vector_codes.compress(frame)[0].collect()), key=repr) == plain_codes(rows)


def test_uneven_parts_are_cut_like_arrays(spark):
    assert vector_codes.edges(10) == [0, 3, 6, 8, 10]
    assert len(coded(spark, [(i, [float(i)] * 10, 0) for i in range(5)])) == 5


@pytest.mark.parametrize("seed", range(5))
def test_active_scan_equals_full_scan(seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-4, 5, (300, 3)), rng.integers(-4, 5, (40, 3))
    entry, distance = vector_codes.full_scan(x, book)
    after = book.copy()
    after[rng.permutation(40)[: rng.integers(0, 41)]] += rng.integers(-2, 3, 3)
    moved = (after != book).any(axis=1)
    again = vector_codes.active_scan(x, after, moved, entry, distance)
    for ours, theirs in zip(again, vector_codes.full_scan(x, after), strict=True):
        assert (ours == theirs).all()


def test_large_numbers_leave_doubles_alone():
    x, book = np.array([[1 << 23, -(1 << 23)]] * 2) + [[0, 0], [0, 1]], np.array([[-(1 << 23), (1 << 23) - 1]])
    plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in book] for r in x]
    assert vector_codes.distances(x, book).tolist() == plain


# Quality ----------------------------------------------------------------------------------------


def test_statistics_equal_plain_counts():
    texts = ["", "One two two. Three!\nOne two two. Three!", "ÄÖ | 12\t!!", " ", "x" * 1_000_000, "a b c d e f a b c d e f"]
    found = {name: col for name, col in zip(quality.NAMES, quality.statistics([t.encode() for t in texts]).T, strict=True)}
    for i, t in enumerate(texts):
        raw, words, lines = t.encode(), t.lower().split(), [x for x in t.split("\n") if x]
        n = max(len(raw), 1)
        assert found["upper"][i] == pytest.approx(sum(65 <= b < 91 for b in raw) / n)
        assert found["beyond_ascii"][i] == pytest.approx(sum(b > 127 for b in raw) / n)
        assert found["pipes"][i] == pytest.approx(t.count("|") / n)
        assert found["empty"][i] == (not raw)
        assert found["word_length"][i] == pytest.approx(np.mean([len(w.encode()) for w in t.split()]) if words else 0)
        assert found["distinct_words"][i] == pytest.approx(len(set(words)) / len(words) if words else 0)
        assert found["commonest_word"][i] == pytest.approx(max(Counter(words).values()) / len(words) if words else 0)
        fives = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        assert found["distinct_fives"][i] == pytest.approx(len(set(fives)) / len(fives) if fives else 0)
        assert found["distinct_lines"][i] == pytest.approx(len(set(lines)) / len(lines) if lines else 0)
        assert found["entropy"][i] == pytest.approx(-sum(c / n * math.log(c / n) for c in Counter(raw).values()))


def test_isotonic_pools_violators():
    raw, share = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1.0, 0.0, 2.0, 3.0]), np.array([2.0, 2.0, 2.0, 3.0]))
    assert raw.tolist() == pytest.approx([0.15, 0.36]) and share.tolist() == pytest.approx([0.25, 1.0])


def _labelled(spark, rows):
    described = quality.describe(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"))
    return described, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")


def test_sums_of_tasks_are_the_normal_equations(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["ab", "CD!", "x1", "|", "\n"], k=rng.randint(0, 30))), i % 2) for i in range(60)]
    described, labels = _labelled(spark, rows)
    space = quality._space(described, 1)
    joined = described.join(labels, "doc_id").withColumn("fold", (F.col("doc_id") % 5).cast("int")).withColumn("quality", F.col("quality").cast("double"))
    sums = quality.normal_equations(joined.repartition(7), space)
    for k in range(quality.FOLDS):
        mine = [r for r in rows if r[0] % 5 == k]
        z = space.features(quality.statistics([t.encode() for _, t, _ in mine]))
        y = np.array([[q] for *_, q in mine])
        assert np.allclose(sums[k], z.T @ np.concatenate([z, y], axis=1))


def test_cosines_approximate_the_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 20_000)
    rng = np.random.default_rng(0)
    n, width = len(quality.NAMES), quality.WIDTH * np.sqrt(len(quality.NAMES))
    space = quality.Space(np.zeros(n), np.ones(n), rng.normal(0, 1 / width, (n, 20_000)), rng.uniform(0, 2 * np.pi, 20_000))
    x = rng.normal(size=(6, n))
    z = space.features(x)[:, :-1]
    gaps = ((np.clip(x, -5, 5)[:, None] - np.clip(x, -5, 5)[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-gaps / (2 * width**2))).max() < 0.05


def test_held_out_accuracy_and_calibration(spark):
    folder = DATA.replace("sf0.001", "sf0.1")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    described = quality.describe(docs).cache()
    model = quality.train(described, labels)
    scored = quality.score(described, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "predicted", "quality").toPandas()
    assert len(scored) > 500
    assert (scored.predicted == scored.quality).mean() > 0.98
    assert (scored.predicted[scored.quality == 0] == 0).mean() > 0.9
    assert ((scored.score - scored.quality) ** 2).mean() < 0.02
    assert scored.score.between(0, 1).all()
    assert (np.diff(model.share) >= 0).all()


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = [(i, "good words here. " * (i % 7 + 1) if i % 3 else "BAD!! ### " * (i % 5 + 1), int(bool(i % 3))) for i in range(150)]
    described, labels = _labelled(spark, rows)
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (quality.train(described, x) for x in (labels, turned))
    assert np.array_equal(first.weights, second.weights) and np.array_equal(first.share, second.share)


def test_scores_of_odd_rows(spark):
    schema = "doc_id long, text string, score string, predicted string, extra int"
    rows = [(1, None, "a", "b", 1), (1, None, "a", "b", 1), (None, "Good words.", None, None, None), (3, "", "a", "b", 2), (4, "long " * 300_000, "a", "b", 3)]
    described = quality.describe(spark.createDataFrame(rows, schema))
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, None), (None, 1), (4, 7)], "doc_id long, quality int")
    model = quality.train(described, labels)
    found = quality.score(described, model).collect()
    assert len(found) == 5 and found[0].asDict().keys() == {"doc_id", "extra", "score", "predicted"}
    by_id = defaultdict(set)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= quality.GOOD)
        by_id[r.doc_id].add(r.score)
    assert by_id[1] == by_id[3]  # null is empty
    none = quality.score(described, quality.train(described, labels.limit(0))).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    empty = quality.describe(spark.createDataFrame([], schema))
    assert quality.train(empty, labels) is None and quality.score(empty, model).count() == 0


def test_one_portion_of_terms_is_held_at_a_time(monkeypatch):
    """Many portions take no more memory than one of them."""
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000))
    monkeypatch.setattr(divergence, "PORTION", 1 << 18)
    texts = [text() for _ in range(100)]

    def peak(rows):
        batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(rows), "source": ["s"] * len(rows), "text": rows})
        tracemalloc.start()
        counted = sum(b.num_rows for b in divergence._count_level(divergence.FIRST_BYTES)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert counted > 0
        return most

    peak(texts[:18])
    assert peak(texts) < 1.2 * peak(texts[:18])


def test_portions_hold_documents_of_few_groups(monkeypatch):
    """Groups that come by turns are counted in few portions each, not in all of them."""
    monkeypatch.setattr(divergence, "PORTION", 1000)
    groups = [(lang, f"s{s}") for lang in ("en", "de") for s in range(5)]
    text = " ".join(f"t{a}{b}xy" for a in "abcd" for b in "efghi")
    rows = [(*groups[i % len(groups)], text) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "source", "text"])
    counted = pa.Table.from_batches(divergence._count_level(8)(iter([batch]))).to_pylist()
    assert len(counted) <= len(groups) * 20 * 4
    sums = Counter()
    for r in counted:
        sums[r["lang"], r["source"], r["key"], r["complete"]] += r["docs"]
    assert sums == {(*g, t.encode(), True): 20 for g in groups for t in text.split()}
