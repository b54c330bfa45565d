"""Edit-aware token counts.

A document is cut into segments at places that are boundaries between pre-tokens whatever stands
around them: before a space that follows a non-space and precedes a letter. Segments are encoded on
their own, and their lengths and token counts are the leaves of a segment tree of sums. An edit is
located by descending the tree; the segments it touches and one segment of context on either side are
cut and encoded anew, and the sums above them change; where an edit changes the number of segments, the sums - not the
segments - are formed anew. The count always equals that of encoding the whole edited text.

One scan; a document's tree lives only while its row is worked on, and its texts are never
concatenated but for the touched region. Null texts are empty; edits beyond the end are clipped, null
edits do nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara.llm.packing import default_tokenizer, exact_encoder

SEGMENT = 128  # characters, at least, before the next cut
_CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")


def segments(text: str, size: int = SEGMENT) -> list[str]:
    out, at = [], 0
    while at < len(text):
        found = _CUT.search(text, at + size)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


class CountTree:
    """Segments of a text under a binary tree of (characters, tokens)."""

    def __init__(self, text: str, encoder, size: int = SEGMENT):
        self.encoder, self.size = encoder, size
        self.encoded_chars = 0
        self.texts = segments(text, size)
        self.leaves = [self._leaf(t) for t in self.texts]
        self._build()

    def _leaf(self, text: str) -> tuple[int, int]:
        self.encoded_chars += len(text)
        return len(text), len(self.encoder.encode_ordinary(text))

    def _build(self) -> None:
        width = 1
        while width < len(self.leaves):
            width *= 2
        self.width = width
        self.sums = [(0, 0)] * width + self.leaves + [(0, 0)] * (width - len(self.leaves))
        for i in range(width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1])

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    def locate(self, place: int) -> tuple[int, int]:
        """The segment that holds a character, and the first character of the segment."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if place >= start + self.sums[i][0]:
                start += self.sums[i][0]
                i += 1
        return i - self.width, start

    def edit(self, place: int, deleted: int, inserted: str) -> None:
        place = min(max(place, 0), self.chars)
        deleted = min(max(deleted, 0), self.chars - place)
        if not deleted and not inserted:
            return
        if not self.leaves:
            first = last = start = 0
            region = inserted
        else:
            low, start = self.locate(min(place, self.chars - 1))
            high, _ = self.locate(min(place + deleted, self.chars - 1))
            first, last = max(low - 1, 0), min(high + 1, len(self.leaves) - 1) + 1
            start -= len(self.texts[first]) if first < low else 0
            region = "".join(self.texts[first:last])
            region = region[: place - start] + inserted + region[place - start + deleted :]
        fresh = segments(region, self.size)
        leaves = [self._leaf(t) for t in fresh]
        same = len(fresh) == last - first
        self.texts[first:last] = fresh
        self.leaves[first:last] = leaves
        if not same:
            self._build()
            return
        for i, leaf in enumerate(leaves, first + self.width):
            self.sums[i] = leaf
        low, high = (first + self.width) // 2, (last - 1 + self.width) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2


def count_edits(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(id, n_chars, n_tokens, n_segments, edited_chars, edited_tokens, reencoded_chars) of
    ``documents`` (id, text, edits: array of (place, deleted, inserted), applied in turn)."""
    path = tokenizer or default_tokenizer()
    kind = documents.schema["id"].dataType.simpleString()

    def scan(batches):
        encoder = exact_encoder(path)
        for b in batches:
            out = ([], [], [], [], [], [])
            for text, edits in zip(b.column("text"), b.column("edits").to_pylist()):
                tree = CountTree(text.as_py() or "", encoder)
                before = (tree.chars, tree.tokens, len(tree.leaves))
                tree.encoded_chars = 0
                for e in edits or ():
                    if e is not None and e["place"] is not None:
                        tree.edit(e["place"], e["deleted"] or 0, e["inserted"] or "")
                for column, x in zip(out, (*before, tree.chars, tree.tokens, tree.encoded_chars)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(c, pa.int64()) for c in out)],
                names=["id", "n_chars", "n_tokens", "n_segments", "edited_chars", "edited_tokens", "reencoded_chars"],
            )

    return documents.select("id", "text", "edits").mapInArrow(
        scan, f"id {kind}, n_chars long, n_tokens long, n_segments long, edited_chars long, edited_tokens long, reencoded_chars long"
    )


def sample_edits(text: Column) -> Column:
    """Three edits that depend on the text alone: a deletion in the middle, its first twenty
    characters inserted at a quarter, and a replacement near the end."""
    n = F.coalesce(F.char_length(text), F.lit(0))

    def one(place: Column, deleted: Column, inserted: Column) -> Column:
        return F.struct(place.cast("long").alias("place"), deleted.cast("long").alias("deleted"), inserted.alias("inserted"))

    return F.array(
        one(F.floor(n / 2), F.lit(10), F.lit("")),
        one(F.floor(n / 4), F.lit(0), F.substring(F.coalesce(text, F.lit("")), 1, 20)),
        one(F.floor(n * 9 / 10), F.lit(5), F.lit(" edited")),
    )


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = documents.select(F.col("doc_id").alias("id"), "text", sample_edits(F.col("text")).alias("edits"))
    return count_edits(rows).withColumnRenamed("id", "doc_id")
