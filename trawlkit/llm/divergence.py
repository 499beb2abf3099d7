"""Source divergence audit: which sources of a language use other terms than the language does.

The terms that a language keeps are those in enough of its documents. They are found by iceberg
prefix refinement: the distinct documents of short byte prefixes are counted first, prefixes below
the threshold are discarded with all their extensions, and longer prefixes are counted only where
their parent survived, until no open prefix is left. Rare long terms are thus never shuffled whole.
All arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawlkit.llm.batches import as_bytes, portions
from trawlkit.llm.common import lookup, null_safe_text
from trawlkit.llm.word_hashes import LOWER, byte_table
from trawlkit.session import written_table

LEAST_DOCUMENTS = 3
# Bytes of the first prefixes; each level doubles them, so levels grow with the log of the longest shared term.
FIRST_BYTES = 8
# Bytes of text handled at once in a task.
PORTION = 4 << 20
# Surviving prefixes are handed to the next level as a bitmap of 16 bits for each, at most 8 MB.
# Two prefixes on one bit only let too much through; the next level counts it exactly.
BITS_EACH, MOST_BITS = 16, 1 << 26
UNIT = 1_000_000_000
TERM_RANKS = 200
# Terms times sources that a task holds as one table, and sources whose sums it makes.
CELLS, SOURCES = 1 << 20, 256

_TERM = byte_table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))

TERMS = "lang string, source string, terms array<binary>, times array<int>"
COUNTED = "lang string, source string, key binary, complete boolean, n long, docs long"


def words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, A-Z lowered, and the text number of each."""
    joined = b"\n".join(texts) + b"\n"
    codes = LOWER[np.frombuffer(joined, np.uint8)]
    inside = _TERM[codes]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    stops = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]]))
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(codes[inside].tobytes())])
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return found, np.searchsorted(ends, starts, side="right")


def _encoded(values: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the place of each among them."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    made = values.dictionary_encode()
    return made.dictionary, made.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(flat: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """Values sorted by owner as a list per owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), flat)


def _terms_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Distinct terms of each document and how often each occurs there."""
    found, owner = words(as_bytes(batch.column("text")))
    distinct, code = _encoded(found)
    pair, times = np.unique(owner * max(len(distinct), 1) + code, return_counts=True)
    text, term = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
    terms = distinct.take(pa.array(term)).cast(pa.binary())
    columns = [batch.column("lang"), batch.column("source"), _lists(terms, text, batch.num_rows), _lists(pa.array(times, pa.int32()), text, batch.num_rows)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "terms", "times"])


def _flat(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a batch; term, count and document of each entry."""
    lists = batch.column("terms")
    distinct, code = _encoded(lists.flatten())
    owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return distinct, code, batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64), owner


def _prefixes(distinct: pa.Array, size: int) -> pa.Array:
    return pc.binary_slice(distinct, 0, size)


def _as_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents or rows of terms as rows of terms.

    Documents are taken group by group, so that few portions count the same term of a group.
    """
    for batch in batches:
        if "text" in batch.schema.names:
            order = pc.sort_indices(batch, sort_keys=[("lang", "ascending"), ("source", "ascending")])
            yield from map(_terms_of, portions([batch.take(order)], "text", PORTION))
        elif batch.num_rows:
            yield batch


def _each(make: Callable[[pa.RecordBatch], pa.RecordBatch], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is made of each batch of terms. Nothing of one batch is held while the next is worked on."""
    for made in map(make, _as_terms(batches)):
        yield made
        del made
        pa.default_memory_pool().release_unused()


def _counted(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    distinct, code, times, owner = _flat(batch)
    whole = pc.binary_length(distinct).to_numpy(zero_copy_only=False) <= size
    langs, lang = _encoded(batch.column("lang"))
    sources, source = _encoded(batch.column("source"))
    width = max(len(distinct), 1)
    here = whole[code] if len(code) else np.zeros(0, bool)
    place = ((lang * len(sources) + source)[owner] * width + code)[here]
    keys, back, docs = np.unique(place, return_inverse=True, return_counts=True)
    n = np.bincount(back, weights=times[here], minlength=len(keys)).astype(np.int64)
    del place, back, times
    group, term = keys // width, keys % width
    columns = [langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))), distinct.take(pa.array(term)), pa.array(np.ones(len(keys), bool)), pa.array(n), pa.array(docs)]
    complete = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "key", "complete", "n", "docs"])
    opened, prefix = _encoded(_prefixes(distinct, size))
    wide = max(len(opened), 1)
    held = np.unique(owner[~here] * wide + prefix[code[~here]])
    keys, docs = np.unique(lang[held // wide] * wide + held % wide, return_counts=True)
    columns = [langs.take(pa.array(keys // wide)), pa.nulls(len(keys), pa.string()), opened.take(pa.array(keys % wide)), pa.array(np.zeros(len(keys), bool)), pa.array(np.zeros(len(keys), np.int64)), pa.array(docs)]
    return pa.concat_batches([complete, pa.RecordBatch.from_arrays(columns, names=["lang", "source", "key", "complete", "n", "docs"])])


def _count_level(size: int):
    """Counts of complete terms by source, and distinct documents of open prefixes, per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _each(lambda batch: _counted(batch, size), batches)

    return run


def _spots(lang: str, prefixes: list[bytes], bits: int) -> np.ndarray:
    """Bit of each prefix of a language."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(p, seed) & (bits - 1) for p in prefixes], np.int64)


def _bitmap(survivors: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """One bit per surviving (lang, key)."""
    bits = min(MOST_BITS, 1 << max(10, (n * BITS_EACH - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lang = _encoded(batch.column("lang"))
            keys = batch.column("key")
            found = [_spots(name, keys.filter(pa.array(lang == k)).to_pylist(), bits) for k, name in enumerate(langs.to_pylist())]
            spots = np.concatenate([*found, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(spots >> 5, pa.int32()), pa.array(np.int64(1) << (spots & 31))], names=["word", "bits"])

    marked = survivors.select("lang", "key").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(bits >> 5, np.uint32)
    held[marked.column("word").to_numpy()] = marked.column("bits").to_numpy()
    return held, bits


def _extended(terms: DataFrame, size: int, survivors: DataFrame, n: int) -> DataFrame:
    """Terms longer than size whose prefix of that size survived."""
    shared = terms.sparkSession.sparkContext.broadcast(_bitmap(survivors, n))

    def alive(batch: pa.RecordBatch) -> pa.RecordBatch:
        held, bits = shared.value
        distinct, code, times, owner = _flat(batch)
        langs, lang = _encoded(batch.column("lang"))
        open_term = pc.binary_length(distinct).to_numpy(zero_copy_only=False) > size
        opened, prefix = _encoded(_prefixes(distinct, size))
        survives = np.zeros((len(langs), len(distinct)), bool)
        here = np.unique(prefix[open_term])
        prefixes = opened.take(pa.array(here)).to_pylist()
        for k, name in enumerate(langs.to_pylist()):
            spots = _spots(name, prefixes, bits)
            good = np.zeros(len(opened), bool)
            good[here] = (held[spots >> 5] >> (spots & 31).astype(np.uint32) & 1).astype(bool)
            survives[k] = open_term & good[prefix]
        kept = survives[lang[owner], code] if len(code) else np.zeros(0, bool)
        owner, code, times = owner[kept], code[kept], times[kept]
        used, place = np.unique(owner, return_inverse=True)
        rows = batch.select(["lang", "source"]).take(pa.array(used))
        columns = [rows.column("lang"), rows.column("source"), _lists(distinct.take(pa.array(code)), place, len(used)), _lists(pa.array(times, pa.int32()), place, len(used))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "terms", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _each(alive, batches)

    return terms.mapInArrow(run, TERMS)


def term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, total): the terms each language keeps, counted by source and in all.

    docs has lang, source (not null) and text. Each row is a document. One level per doubling of
    the prefixes. The first level reads the texts and writes no terms; every later one writes and
    reads only the terms whose parents survived.
    """
    terms = docs.select("lang", "source", "text")
    size, complete = FIRST_BYTES, []
    while True:
        summed = terms.mapInArrow(_count_level(size), COUNTED).groupBy("lang", "source", "key", "complete").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        counted = written_table(summed, f"prefixes{size}")
        complete.append(counted.where("complete"))
        survivors = counted.where(~F.col("complete") & (F.col("docs") >= least))
        n = survivors.count()
        if not n:
            break
        terms = written_table(_extended(terms, size, survivors, n), f"terms{size}")
        size *= 2
    found = complete[0]
    for more in complete[1:]:
        found = found.unionByName(more)
    kept = found.groupBy("lang", "key").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least)
    # Written, so that both sides of the join are plain shuffles whose large keys can be split.
    kept = written_table(kept.select("lang", "key", "total"), "kept")
    return found.join(kept, ["lang", "key"]).select("lang", "source", F.col("key").cast("string").alias("term"), "n", "total")


def _share(n: Column, all_n: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (all_n + terms)), exact for any counts."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (n + F.lit(1)).cast("decimal(20,0)")
    under = (all_n + terms).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide, under)


def _surprise(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(entries: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of the surprise of each source of a portion against every source, over a block of terms."""
    names = sources.column("source").to_pylist()
    absent = sources.column("absent").to_numpy()
    mine = np.flatnonzero(sources.column("mine").to_numpy())
    lang = sources.column("lang")[0].as_py()
    sums = np.zeros((len(mine), len(names)), np.int64)
    if entries.num_rows:
        place = {s: i for i, s in enumerate(names)}
        terms, term = _encoded(entries.column("term"))
        distinct, source = _encoded(entries.column("source"))
        row = np.array([place[s] for s in distinct.to_pylist()])[source]
        table = np.repeat(absent[:, None], len(terms), axis=1)
        table[row, term] = entries.column("p").to_numpy()
        for i, s in enumerate(mine.tolist()):
            gap = table[s] - table
            sums[i] = (gap * gap // table).sum(axis=1)
    first, second = np.divmod(np.arange(sums.size), max(len(names), 1))
    other = mine[first] != second if sums.size else np.zeros(0, bool)
    labels = pa.array(names, pa.string())
    columns = {
        "lang": pa.array([lang] * int(other.sum()), pa.string()),
        "source": labels.take(pa.array(mine[first[other]])),
        "item": labels.take(pa.array(second[other])),
        "value": pa.array(sums.ravel()[other]),
    }
    return pa.table(columns)


def _groups(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Every group that occurs: lang, source, all_n, terms, absent (p of a kept term that it lacks),
    lang_n, lang_sources."""
    own = docs.select("lang", "source").distinct()
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("all_n"))
    kept = entries.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_n"))
    sizes = own.groupBy("lang").agg(F.count("*").alias("lang_sources"))
    full = own.join(sums, ["lang", "source"], "left").join(sizes, "lang").join(kept, "lang", "left").na.fill(0, ["all_n", "terms", "lang_n"])
    return full.withColumn("absent", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("all_n"), F.col("terms"))).otherwise(F.lit(1).cast("long")))


def _ranked(rows: DataFrame, part: str, most: int | None) -> DataFrame:
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = rows.withColumn("rank", place)
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank of every group of documents by language and source.

    Part `pair` ranks the other sources of the language by how far their shares of terms are from
    the group's; part `term` ranks the kept terms that the group uses more than its language does,
    to term_ranks. Values fall with the rank, ties go to the item that sorts first as UTF-8. Null
    texts, languages and sources are empty ones. Each row is a document, also if rows repeat.
    Groups without kept terms have pairs; a group that is alone in its language has none. Other
    columns play no part. No rows give no rows.
    """
    docs = documents.select(*[null_safe_text(lookup(documents, c)).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))])
    entries = written_table(term_counts(docs, least), "entries")
    groups = written_table(_groups(docs, entries), "groups")
    with_p = entries.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("all_n"), F.col("terms")))

    q = _share(F.col("total"), F.col("lang_n"), F.col("terms"))
    over = with_p.withColumn("q", q).where(F.col("p") > F.col("q"))
    terms = over.select("lang", "source", F.col("term").alias("item"), _surprise(F.col("p"), F.col("q")).alias("value"))

    # Blocks of terms times portions of sources: no task holds a whole language.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("lang_sources") / F.lit(CELLS))).cast("int")
    chunks = F.ceil(F.col("lang_sources") / F.lit(SOURCES)).cast("int")
    spread = with_p.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    every = groups.select("lang", "source", "absent", chunks.alias("chunks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    mine = F.pmod(F.xxhash64("source"), F.col("chunks")) == F.col("chunk")
    every = every.select("lang", "source", "absent", mine.alias("mine"), "block", "chunk")
    keys = ("lang", "block", "chunk")
    sums = spread.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(pairs, "pair", None).unionByName(_ranked(terms, "term", term_ranks))
