"""Operators on texts against plain versions, over whole small tables and odd rows."""

import hashlib
import random
import re
from collections import Counter

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawlkit.llm import common, language, lines, packing, personal_data, pieces, queries, repeats, shingle_join, toxicity

ODD = [None, "", " ", "\n\n", "x", "a" * 100_000, "9" * 60_000, "1.2.3.4 " * 3000, "the same text", "the same text", "𝄞 ünï ▁x  y", "▁▁", "tab\tand\rreturn\x0b\x00"]


@pytest.fixture(scope="module")
def texts(spark, data):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


def odd_rows(documents):
    return documents([(i, t, "en", f"s{i % 3}") for i, t in enumerate(ODD)] + [(None, "no id", None, None), (3, "twice", "en", "s"), (3, "twice", "en", "s")])


# Personal data


def test_base_spans_of_the_table(spark, data, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op6_personal_data"](spark, data).collect()}
    for doc_id, text, _ in texts:
        want = brute.base_spans(text)
        assert got[doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        counts = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert [got[doc_id][f"n_{k}"] for k, _ in brute.PATTERNS] == [counts[k] for k, _ in brute.PATTERNS]


TRICKY = [
    "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1", "+12", "x+1.2.3.4-5 6(7)8 90", " 4111 1111 1111 1111 and +49 30 1234567890, a@1.2.3.4 ë 𝄞 b@c.d",
    "0000255.1.2.3 256.1.1.1", "1-2-3-4-5-6-7-8-9-0 1 2 3 4 5 6 7", "a@" * 50 + "b.c", "a@b." * 300 + "c", "+" * 100 + "1" * 14, "@@a@b..c@d.e", "%@-.-", "4111-1111-1111-1111-",
]


def test_base_spans_of_tricky_texts(documents):
    rows = TRICKY + ODD
    found = personal_data.find_personal_data(documents(list(enumerate(rows)))).select("doc_id", personal_data.joined_spans("base_spans").alias("s"))
    for r in found.collect():
        assert r.s == brute.base_spans(rows[r.doc_id]), rows[r.doc_id][:80]


def test_random_spans(documents):
    rng = random.Random(4)
    rows = ["".join(rng.choice("a1@.+- ()9é") for _ in range(60)) for _ in range(400)]
    found = personal_data.find_personal_data(documents(list(enumerate(rows)))).select("doc_id", personal_data.joined_spans("base_spans").alias("s"))
    assert {r.doc_id: r.s for r in found.collect()} == {i: brute.base_spans(t) for i, t in enumerate(rows)}


def test_context_and_checksum_decide_on_additional_kinds(documents):
    rows = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE88 3704 0044 0532 0130 00", "my ssn 123-45-6789", "part 123-45-6789", "tel 212-555-0123", "n 212-555-0123"]
    got = personal_data.find_personal_data(documents(list(enumerate(rows)))).select("doc_id", personal_data.joined_spans("personal_spans").alias("s"))
    assert {r.doc_id: r.s for r in got.collect()} == {0: "iban:5:32", 1: "", 2: "ssn:7:18", 3: "", 4: "local_phone:4:16", 5: ""}


def test_redaction_replaces_finds_and_nothing_else(documents):
    rows = ["mail a.b@c.de now", "call +49 30 1234567890", "4111 1111 1111 1111", "at 10.0.0.1!", "10.0.0.999 stays", None, ""]
    out = {r.doc_id: r.text for r in personal_data.redact(documents(list(enumerate(rows)))).collect()}
    assert out == {0: "mail [EMAIL] now", 1: "call [PHONE]", 2: "[CARD]", 3: "at [IP]!", 4: "10.0.0.999 stays", 5: None, 6: ""}


# Lines


def test_lines_near_the_threshold(documents):
    rows = [(100 * n + s, f"own {n} {s}\nline {n}\n\tline {n} ", f"site{s}") for n in (9, 10, 11, 14) for s in range(n)]
    rows += [(9000, None, "a"), (9001, "", "a"), (9002, "\n\n", None), (9003, "line 14\nline 14", None), (9004, "line 14\nmine", None)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.drop_spread_lines(documents([(i, t, None, s) for i, t, s in rows])).collect()}
    assert got == {i: (t, n, m) for i, t, n, m in brute.without_lines(rows)}
    assert got[1400][2] == 2 and got[900][2] == 0 and got[9003][2] == 0


def test_line_sketch_band_counts_exactly(documents):
    rows = [(k, f"far spread\nown {k}", None, f"s{k}") for k in range(300)]
    for least, removed in ((300, 1), (301, 0), (250, 1), (400, 0)):
        out = lines.drop_spread_lines(documents(rows), min_sites=least)
        assert {r.n_removed for r in out.collect()} == {removed}


def test_line_dedup_keeps_rows_and_clashing_columns(documents):
    table = odd_rows(documents).withColumn("N_Removed", F.lit("own"))
    out = lines.drop_spread_lines(table)
    assert out.count() == table.count() and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_removed"]


# N-gram join


def test_similar_documents_of_the_table(spark, data, texts):
    got = sorted(tuple(r) for r in queries.QUERIES["op10_ngram_join"](spark, data).collect())
    assert got == sorted(brute.similar([(i, t) for i, t, _ in texts]))


def near_copies(rng, base, copies, changes):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(changes):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**9)}"
        out.append(" ".join(words))
    return out


def test_similar_documents_of_groups_and_edges(documents, monkeypatch):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    base, passage = [word() for _ in range(120)], " ".join(word() for _ in range(60))
    rows = near_copies(rng, base, 60, 1) + near_copies(rng, base, 40, 3) + [" ".join(base)] * 5
    rows += [passage + " " + " ".join(word() for _ in range(n)) for n in (0, 1, 5, 14, 15, 16, 17, 40, 60, 60, 60)]
    rows += ["One two THREE", "one  two three", "one two", "", None, "  ", "é É", "É é"]
    monkeypatch.setattr(shingle_join, "CHUNK", 16)
    monkeypatch.setattr(shingle_join, "TASK_ROWS", 500)
    pairs = list(enumerate(rows))
    rng.shuffle(pairs)
    got = shingle_join.similar_documents(documents(pairs)).select("doc_id", "n_shingles", "component_id")
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.similar(pairs))


def test_similar_documents_of_odd_rows(documents):
    rows = shingle_join.similar_documents(odd_rows(documents)).collect()
    assert len(rows) == len(ODD) + 3
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert shingle_join.similar_documents(documents([(1, "x")]).limit(0)).count() == 0


def test_texts_of_similar_documents_are_kept_small(documents, monkeypatch):
    tables, keep = {}, shingle_join.written_table

    def kept(df, name="table", *codec):
        tables[name] = keep(df, name, *codec)
        return tables[name]

    monkeypatch.setattr(shingle_join, "written_table", kept)
    rows = ["one two three four five six seven", "One two three four five six seven", "one two three four five six eight"]
    assert shingle_join.similar_documents(documents(list(enumerate(rows)))).count() == 3
    assert tables["texts"].inputFiles() and all(".zstd." in f for f in tables["texts"].inputFiles())


# Repeated strings


def test_repeats_of_the_table(spark, data, texts):
    got = sorted(tuple(r) for r in queries.QUERIES["op9_repeats"](spark, data).collect())
    assert got == sorted((i, *w) for (i, _, _), w in zip(texts, brute.without_repeats([t for _, t, _ in texts]), strict=True))


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats_of_overlaps_and_edges(documents, monkeypatch, hot):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    p, q = some(900), some(401)
    rows = ["", None, "a" * 3000, "ab" * 1000, some(100) + p + some(50), some(300) + p, p[:500] + some(10) + p[100:600], some(50) + q, q + some(20), q[:400], q[1:]]
    rows += ["x" * 399, "y" * 400, "y" * 400, some(5000), p + p, some(200) + "z" * 700 + some(100) + "z" * 401]
    monkeypatch.setattr(repeats, "HOT_SEGMENTS", hot)
    got = repeats.remove_repeats(documents(list(enumerate(rows))).select("doc_id", "text"))
    want = [(i, *w) for i, w in enumerate(brute.without_repeats(rows))]
    assert sorted(tuple(r)[:5] for r in got.collect()) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    rng = random.Random(9)
    text = bytes(rng.randrange(97, 123) for _ in range(9000))
    whole = repeats.segments([text])
    monkeypatch.setattr(repeats, "PART_BITS", 11)
    cut = repeats.segments([text])
    assert cut["starts"].sum() == whole["starts"].sum() == len(text) - repeats.WINDOW + 1
    assert set(whole["anchor"]) <= set(cut["anchor"]) and len(cut["start"]) > len(whole["start"])


def test_merged_blocks_equal_counting():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(400, 460))) for _ in range(30)]
    parts += [parts[0], parts[1][:430] + b"c", b"q" * 900]
    laid, times = b"".join(parts), Counter()
    for p in parts:
        times.update(p[i : i + 400] for i in range(len(p) - 399))
    starts, at = [], 0
    for p in parts:
        starts += [at + i for i in range(len(p) - 399) if times[p[i : i + 400]] > 1]
        at += len(p)
    assert repeats.repeated_starts(parts).tolist() == starts and len(laid) == at


# Pieces


@pytest.fixture(scope="module")
def model():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark, data, texts, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: r for r in queries.QUERIES["op7_sentencepiece"](spark, data).collect()}
    for doc_id, text, _ in texts:
        ids = library.encode(text or "", add_eos=True)
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_random_texts(documents, model):
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=model), random.Random(1)
    marks = [*"ab c  é▁\n\t<s>/0x41 ﬁ²ü𝄞　\x00\r한글", "</s>", "<s>", "<0x41>", "<unk>", "the", "hello"]
    rows = ["".join(rng.choice(marks) for _ in range(rng.randrange(14))) for _ in range(1500)] + ODD
    out = pieces.encode_decode(documents(list(enumerate(rows))), model, columns=("n_tokens", "ids", "decoded"))
    for r in out.collect():
        want = library.encode(rows[r.doc_id] or "", add_eos=True)
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == library.decode(want)


# Language and toxicity


def test_language_of_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = queries.QUERIES["op1_language_id"](spark, data).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.9
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) / len(got) < 0.02


def test_language_of_odd_rows(spark, data, documents):
    model = language.train(spark.read.parquet(f"{data}/documents.parquet"))
    table = odd_rows(documents).withColumn("Score", F.lit("own"))
    rows = language.predict(table, model).collect()
    assert len(rows) == table.count()
    for r in rows:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter) and (letter or (r.rejected and r.score == 0))
    assert {r.lang_pred for r in language.predict(odd_rows(documents), None).collect()} == {"und"}
    assert language.train(documents([(1, "x")]).limit(0)) is None


def test_subwords_do_not_cross_words_or_texts():
    one = language.subwords(["Ab cd"])
    two = language.subwords(["ab", "CD!"])
    assert sorted(one[0]) == sorted(two[0]) and set(two[1]) == {0, 1} and two[3].tolist() == [2, 2]


def test_toxicity_tells_held_out_rows_apart(spark, data):
    big = data.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    graded = toxicity.grade_labels(labels)
    model = toxicity.train(docs, graded.where("doc_id % 3 <> 0"), 3)
    rows = toxicity.predict(docs.select("doc_id", "text"), model, keep_text=False).join(graded.where("doc_id % 3 = 0").withColumnRenamed("grade", "truth"), "doc_id").collect()
    toxic, rest = [r for r in rows if r.truth == 2], [r for r in rows if r.truth == 0]
    assert sum(r.toxic for r in toxic) / len(toxic) >= 0.8 and sum(r.toxic for r in rest) / len(rest) <= 0.01
    mean = lambda part: sum(r.severity for r in part) / len(part)
    assert mean(rest) < 0.5 < 1.5 < mean(toxic)
    assert list(model.thresholds) == sorted(model.thresholds)


def test_toxicity_of_odd_rows(documents):
    assert {r.toxic for r in toxicity.predict(odd_rows(documents), None).collect()} == {False}
    graded = documents([(i, f"bad awful {i}" if i % 2 else f"fine good {i}") for i in range(80)])
    model = toxicity.train(graded, graded.select("doc_id", (F.col("doc_id") % 2 * 2).alias("grade")), 3)
    assert toxicity.predict(odd_rows(documents), model).count() == len(ODD) + 3
    assert [r.toxic for r in toxicity.predict(documents([(1, "BAD awful thing"), (2, "fine")]), model).orderBy("doc_id").collect()] == [True, False]


# Packing


@pytest.mark.parametrize("seed", range(4))
def test_boundaries_are_the_best(seed):
    import numpy as np

    rng = random.Random(seed)
    lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 60))]
    kinds, counts = np.unique(lengths, return_counts=True)
    for buckets in (1, 2, 3, 4):
        bounds = packing.boundaries(kinds, counts, buckets)
        assert len(bounds) <= buckets and sum(min(b for b in bounds if b >= n) for n in lengths) == brute.least_padding(lengths, buckets)


def test_packing_is_whole_and_within_budget(spark, data, texts, monkeypatch):
    monkeypatch.setattr(packing, "SHARE_ROWS", 20)
    rows = packing.pack(spark.read.parquet(f"{data}/documents.parquet"), buckets=5, budget=3000, max_length=700).collect()
    words = Counter({i: len(re.findall(r"[^ \t-\r]+", t or "")) for i, t, _ in texts})
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
        assert r.start == r.piece * 700 and r.n_tokens <= r.bucket <= 700
    assert total == +words
    batches = Counter((r.bucket, r.batch) for r in rows)
    room = {b: max(1, 3000 // b) for b, _ in batches}
    last = {b: max(k for c, k in batches if c == b) for b in room}
    assert all(n == room[b] or (k == last[b] and n < room[b]) for (b, k), n in batches.items())
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)


def test_packing_of_odd_rows(documents):
    got = Counter(r.doc_id for r in packing.pack(odd_rows(documents)).collect())
    assert got[0] == got[1] == got[2] == 0 and got[3] == 2 and got[None] == 1
    assert packing.pack(documents([(1, None)])).count() == 0 and packing.pack(documents([(1, "x")]).limit(0)).count() == 0


def test_account_numbers_whatever_follows(spark, documents):
    account = "DE89 3704 0044 0532 0130 00"
    other = "GB82 WEST 1234 5698 7654 32"
    after = [" BIC COBADEFF", " 7 days", "\nNEXT", " X", ".", "", f" {other}", f" {account}", " BIC X DE"]
    rows = [f"IBAN {account}{a}" for a in after] + [f"IBAN {account.replace(' ', '')}{a}" for a in after]
    got = personal_data.find_personal_data(documents(list(enumerate(rows)))).select("doc_id", personal_data.joined_spans("personal_spans").alias("s"))
    for r in got.collect():
        size = 27 if r.doc_id < len(after) else 22
        spans = [f"iban:5:{5 + size}"]
        if r.doc_id % len(after) in (6, 7):
            spans.append(f"iban:{6 + size}:{6 + size + 27}")
        assert r.s == ",".join(spans), rows[r.doc_id]
    redacted = personal_data.redact(documents(list(enumerate(rows)))).collect()
    assert all("3704" not in r.text and "WEST" not in r.text for r in redacted)
    # A wrong check, a number cut off and one with a letter right behind are no accounts.
    wrong = ["IBAN DE88 3704 0044 0532 0130 00 BIC X", "IBAN DE89 3704 0044 0532 0130", f"IBAN {account}Q"]
    assert {r.s for r in personal_data.find_personal_data(documents(list(enumerate(wrong)))).select(personal_data.joined_spans("personal_spans").alias("s")).collect()} == {""}


@pytest.mark.parametrize("n", [10**k for k in range(3, 13)])
def test_classes_of_any_size_keep_their_chance(n):
    share = (common.chance_bound(n, 1000) + 1) / 2**63
    assert share == pytest.approx(min(1, 1000 / n), rel=1e-9)


def test_grades_out_of_range_are_no_grades(spark, documents):
    docs = documents([(i, f"word{i % 3} bad" if i % 2 else "word good") for i in range(40)])
    grades = spark.createDataFrame([(i, [0, 2, 9, -1][i % 4]) for i in range(40)], "doc_id long, grade int")
    assert toxicity.train(docs, grades, n_grades=3) is not None


def test_pieces_of_an_overloaded_anchor(documents, monkeypatch):
    """A passage in many texts: a few pieces a text, not a row for each of its strings, and equal results."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passage, made, cut = letters(700), [], repeats._cut_pieces
    texts = [letters(rng.randrange(500)) + passage[rng.randrange(90) : 700 - rng.randrange(90)] + letters(rng.randrange(500)) for _ in range(40)]
    texts += [texts[3], texts[4][5:], None, "", passage]
    frame = documents(list(enumerate(texts))).select("doc_id", "text")
    usual = {r.doc_id: r[1:] for r in repeats.remove_repeats(frame, keep_bytes=False).collect()}

    def counted(width):
        made.append(width)
        return cut(width)

    monkeypatch.setattr(repeats, "HOT_SEGMENTS", 2)
    monkeypatch.setattr(repeats, "_cut_pieces", counted)
    assert {r.doc_id: r[1:] for r in repeats.remove_repeats(frame, keep_bytes=False).collect()} == usual
    assert made == list(repeats.PIECES)

    batch = pa.RecordBatch.from_pydict({"k1": [1], "k2": [2], "start": [7], "bytes": [passage[:600].encode()]})
    pieces = next(cut(repeats.PIECES[0])(iter([batch])))
    starts = [s + i - 7 for s, b in zip(pieces["start"].to_pylist(), pieces["bytes"].to_pylist(), strict=True) for i in range(len(b) - repeats.WINDOW + 1)]
    assert starts == list(range(201)) and pieces.num_rows <= 6
