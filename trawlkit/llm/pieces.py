"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary crosses from a character to a whitespace marker, so a text falls into
chunks (markers and what follows them) that are segmented on their own. Each task keeps a table
of the distinct chunks it has met, segments a chunk once, and joins ids back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trawlkit.llm.batches import portions

MARKER = "▁"
# Chunks a task's table may hold before it is begun anew: bounds its memory, not the result.
TABLE_CHUNKS = 300_000

KINDS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


@cache
def processor(model: str):
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=model)
    crossing = re.compile(f"[^{MARKER}]{MARKER}")
    if any(crossing.search(made.id_to_piece(i)) for i in range(made.get_piece_size())):
        raise ValueError("pieces of this model cross whitespace markers")
    if made.encode("a  a") != [*made.encode("a"), *made.encode(" a")]:
        raise ValueError("this model's normalisation changes white space")
    return made


def chunks(text: str) -> list[str]:
    """The text's chunks, each without the first of its leading markers; markers shown as spaces."""
    if not text:
        return []
    text = text.replace(MARKER, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in re.findall(" +[^ ]*", " " + text)]


class ChunkTable:
    """Ids, their decimal text and the decoded text of each distinct chunk."""

    def __init__(self, model: str):
        self.model = processor(model)
        self.ids: dict[str, list[int]] = {}
        self.shown: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.lead = self.model.encode("a")
        self.skip = len(self.model.decode(self.lead))

    def add(self, keys: set[str]) -> None:
        if len(self.ids) > TABLE_CHUNKS:
            self.ids, self.shown, self.decoded = {}, {}, {}
        new = list(keys - self.ids.keys())
        # The library puts a marker before a text, but not before an empty one.
        found = self.model.encode(new, num_threads=1)
        found = [ids or [self.model.piece_to_id(MARKER)] for ids in found]
        # After another chunk, so that the leading space is not taken for the library's own marker.
        back = self.model.decode([self.lead + ids for ids in found], num_threads=1) if found else []
        for key, ids, text in zip(new, found, back, strict=True):
            self.ids[key] = ids
            self.shown[key] = " ".join(map(str, ids))
            self.decoded[key] = text[self.skip :]


def encode_decode(docs: DataFrame, model: str, text: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids"), end_id: bool = True) -> DataFrame:
    """Encode every whole text with a sentencepiece model, and decode the ids.

    columns chooses from n_tokens (all ids, the end id included), ids, ids_sha256 (decimal ids
    joined by a space), decoded, decoded_sha256. The text itself is not in the result; other columns
    are, but for own ones of these names. A null text counts as empty: just the end id.
    """
    kept = [c for c in docs.columns if c != text and c.lower() not in columns]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(c, KINDS[c]) for c in columns]])
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        end = table.model.eos_id()
        for batch in portions(batches, text):
            split = [chunks(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            table.add(set().union(*split))
            made: dict[str, list] = {c: [] for c in columns}
            for keys in split:
                shown = " ".join([table.shown[k] for k in keys])
                if end_id:
                    shown = f"{shown} {end}" if keys else str(end)
                if "n_tokens" in made:
                    made["n_tokens"].append(shown.count(" ") + 1 if shown else 0)
                if "ids" in made:
                    made["ids"].append([i for k in keys for i in table.ids[k]] + [end] * end_id)
                if "ids_sha256" in made:
                    made["ids_sha256"].append(hashlib.sha256(shown.encode()).hexdigest())
                if "decoded" in made or "decoded_sha256" in made:
                    whole = "".join([table.decoded[k] for k in keys])[1:]
                    if "decoded" in made:
                        made["decoded"].append(whole)
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(whole.encode()).hexdigest())
            arrays = [*[batch.column(batch.schema.get_field_index(c)) for c in kept], *[pa.array(v, kinds[c]) for c, v in made.items()]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *columns])

    return docs.mapInArrow(run, schema)
