"""SentencePiece N-best segmentation over the piece lattice, and decoding.

White space becomes the vocabulary's space mark, so a text's lattice falls apart at marks that
follow another character: no piece crosses them. In each part forward Viterbi gives the best score
from its start to every place, and the second best; with these as exact heuristics a backward A-star search pops
complete segmentations in the order of their scores. A place is expanded once for each segmentation asked for at
most, paths are linked cells, and the pieces that end at a place are looked up when it is popped, so a part
costs time in proportion to its length even where all scores are tied, as in a line of dashes. The text's
N best are then merged from its parts: each alternative is worth its loss against the part's best,
and a best-first search over the parts whose second best loses least yields the least total losses.

Scores are counted in whole units, 2^-30 or coarser, so that sums are exact and ties are ties. Of several best segmentations
the one with the longer piece, looking from the end of a part, comes first; later ties come in the order of the search,
which depends on the part alone. Characters without a piece are encoded as their
bytes, each of which scores below every piece of the vocabulary.
One scan, no shuffle; a worker keeps the parts it has met in a table of bounded size. Null and empty texts
have one empty segmentation.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Sequence
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNIT = 1 << 30  # the finest part of a score that counts
BELOW = 10  # how far a byte lies below the least score of the vocabulary
KEPT = 16_000_000  # characters of parts, and 24 for each part, that a worker remembers before it starts anew
LISTED, LISTED_PART = 20_000, 32  # parts, of so many characters at most, whose n best a worker remembers
_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

_VOCABULARIES: dict = {}


class Pieces:
    """A vocabulary with the segmentations it has found so far."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.id = {t: i for i, t in enumerate(self.text) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        scores = [model.get_score(i) for i in range(size)]
        self.unit = 1  # scores are kept as whole numbers of 1 / unit
        while self.unit < UNIT and any((x * self.unit) % 1 for x in scores):
            self.unit *= 2
        self.score = [float(round(x * self.unit)) for x in scores]  # whole doubles, whose sums are exact below 2^53
        self.byte_score = min(self.score[i] for i in self.id.values()) - BELOW * self.unit
        lengths = sorted({len(t) for t in self.id} | {1}, reverse=True)
        self.lengths = [[n for n in lengths if n <= end] for end in range(lengths[0] + 1)]  # of pieces that may end there
        # what a piece stands for; an ASCII byte is a character by itself
        self.shown = [chr(self.value[i]) if self.value.get(i, 128) < 128 else t.replace(MARK, " ") for i, t in enumerate(self.text)]
        self.is_wide = np.isin(np.arange(size), [i for i, b in self.value.items() if b >= 128])
        self.ends = ahocorasick.Automaton()  # the pieces that end at a place, longest first
        for t, i in self.id.items():
            self.ends.add_word(t, (len(t), self.score[i], (i,)))
        ascii = {chr(b): i for b, i in self.byte.items() if b < 128 and chr(b) not in self.id}
        for t, i in ascii.items():
            self.ends.add_word(t, (1, self.byte_score, (i,)))
        self.found = {t: (len(t), self.score[i], (i,)) for t, i in self.id.items()} | {t: (1, self.byte_score, (i,)) for t, i in ascii.items()}
        self.single = {t for t in self.id if len(t) == 1} | ascii.keys()
        self.ends.make_automaton()
        self.known: dict[str, tuple] = {}
        self.listed: dict[tuple[str, int], list] = {}
        self.held = 0

    def spelled(self, character: str) -> tuple[int, float, tuple[int, ...]]:
        """A character without a piece as its bytes."""
        ids = tuple(self.byte[b] for b in character.encode("utf-8", "surrogatepass"))
        return 1, self.byte_score * len(ids), ids

    def arcs_with_bytes(self, part: str):
        """(last place, piece) of every piece in the part, by place, the longest first; a piece is (length, score, ids)."""
        done = 0
        for last, piece in self.ends.iter(part):
            while done <= last:  # whatever ends before a piece's last character comes before it
                if part[done] not in self.single:
                    yield done, self.spelled(part[done])
                done += 1
            yield last, piece
        for place in range(done, len(part)):
            if part[place] not in self.single:
                yield place, self.spelled(part[place])

    def ending(self, part: str, end: int):
        """The pieces that end at a place, longest first."""
        for length in self.lengths[min(end, len(self.lengths) - 1)]:
            if piece := self.found.get(part[end - length : end]):
                yield piece
        if part[end - 1] not in self.single:
            yield self.spelled(part[end - 1])

    def nbest(self, part: str, n: int):
        """The ``n`` best segmentations (score, ids) of a part, best first."""
        forward = [0.0, *[-math.inf] * len(part)]
        plain = self.single.issuperset(part)
        for last, (length, x, _) in self.ends.iter(part) if plain else self.arcs_with_bytes(part):
            total = forward[last + 1 - length] + x
            if total > forward[last + 1]:
                forward[last + 1] = total
        push, pop = heapq.heappush, heapq.heappop
        heap, made, popped = [(-forward[-1], len(part), 0, 0.0, None)], 0, {}
        while heap:
            total, place, _, behind, path = pop(heap)
            if place == 0:
                ids: list[int] = []
                while path:
                    piece, path = path
                    ids.extend(piece)
                yield -total, tuple(ids)
                continue
            popped[place] = popped.get(place, 0) + 1
            if popped[place] > n:  # n better ways from here to the end are known
                continue
            for length, x, piece in self.ending(part, place):
                made += 1
                start = place - length
                push(heap, (-(forward[start] + x + behind), start, made, behind + x, (piece, path)))

    def margin(self, part: str) -> tuple[float, tuple[int, ...], float]:
        """The best score of a part, its ids, and what the second best loses (infinite without one), from
        one forward pass for the two best scores up to every place."""
        first, second, back = [0.0, *[-math.inf] * len(part)], [-math.inf] * (len(part) + 1), [None] * (len(part) + 1)
        plain = self.single.issuperset(part)
        for last, piece in self.ends.iter(part) if plain else self.arcs_with_bytes(part):
            length, x, _ = piece
            end = last + 1
            start = end - length
            total = first[start] + x
            best = first[end]
            if total > best:
                other = second[start] + x
                second[end] = other if other > best else best
                first[end] = total
                back[end] = piece
            elif total > second[end]:
                second[end] = total
        place = len(part)
        if place <= LISTED_PART:
            ids = ()
            while place:
                length, _, piece = back[place]
                ids, place = piece + ids, place - length
            return first[-1], ids, first[-1] - second[-1]
        pieces = []
        while place:
            length, _, piece = back[place]
            pieces.append(piece)
            place -= length
        return first[-1], tuple(chain.from_iterable(reversed(pieces))), first[-1] - second[-1]

    def best(self, part: str) -> tuple[float, tuple[int, ...], float]:
        """``margin`` of a part, from the table of known ones if it is there."""
        found = self.known.get(part)
        if found is None:
            self.held += len(part) + 24
            if self.held > KEPT:
                self.known.clear()
                self.held = len(part) + 24
            found = self.known[part] = self.margin(part)
        return found

    def alternatives(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """``nbest`` of a part as a list, from the table of known ones if it is there."""
        found = self.listed.get((part, n))
        if found is None:
            found = list(islice(self.nbest(part, n), n))
            if len(part) <= LISTED_PART:
                if len(self.listed) >= LISTED:
                    self.listed.clear()
                self.listed[part, n] = found
        return found

    def segment(self, text: str, n: int) -> list[tuple[float, Sequence[int]]]:
        """The n best segmentations of a text: (score, ids), best first."""
        if not text:
            return [(0.0, [])]
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            parts = _PART.findall(MARK + text.replace(" ", MARK))
        else:  # single marks: every word is a part
            parts = (MARK + text.replace(" ", f" {MARK}")).split(" ")
        found = list(map(self.known.get, parts))
        if not all(found):
            found = [f or self.best(p) for p, f in zip(parts, found)]
        scores, best, losses = zip(*found)
        ids, total = array("I", chain.from_iterable(best)), sum(scores)
        # only the parts whose second best loses least can take part in the n best
        near = heapq.nsmallest(n - 1, zip(losses, range(len(parts)))) if n > 1 else []
        near = [i for loss, i in near if loss < math.inf]
        ends = list(accumulate(map(len, best))) if near else []
        options = []
        for i in near:
            listed = self.alternatives(parts[i], n)
            options.append([(listed[0][0] - s, found) for s, found in listed])
        out = []
        heap = [(0.0, (0,) * len(options))]
        met = {heap[0][1]}
        while heap and len(out) < n:
            loss, choice = heapq.heappop(heap)
            chosen = ids
            for i, o, c in sorted(zip(near, options, choice), key=lambda x: -x[0]):  # from the back, so that places hold
                if c:
                    chosen = chosen[: ends[i] - len(best[i])] + array("I", o[c][1]) + chosen[ends[i] :]
            out.append(((total - loss) / self.unit, chosen))
            for k, o in enumerate(options):
                if choice[k] + 1 < len(o):
                    other = (*choice[:k], choice[k] + 1, *choice[k + 1 :])
                    if other not in met:
                        met.add(other)
                        heapq.heappush(heap, (loss - o[choice[k]][0] + o[choice[k] + 1][0], other))
        return out

    def decode(self, ids) -> str:
        at = np.asarray(ids, np.int64)
        if not self.is_wide[at].any():
            text = "".join(map(self.shown.__getitem__, ids))
            return text[1:] if text.startswith(" ") else text
        out, raw = [], bytearray()
        for i, wide in zip(ids, self.is_wide[at].tolist()):
            if wide:
                raw.append(self.value[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.shown[i])
        out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


def pieces(path: str) -> Pieces:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Pieces(path)
    return _VOCABULARIES[path]


def encode(documents: DataFrame, n: int = 4, model: str | None = None) -> DataFrame:
    """(id, n_pieces, ids_crc32, round_trip, nbest) of ``documents`` (id, text); nbest is an array of
    (score, n_pieces, ids_crc32), best first; round_trip: decoding the best gives the text."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    kind = documents.schema["id"].dataType.simpleString()
    row = pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())])

    def scan(batches):
        vocabulary = pieces(model)
        for b in batches:
            counts, sums, same, lists = [], [], [], []
            for value in b.column("text"):
                text = value.as_py() or ""
                found = vocabulary.segment(text, n)
                listed = [{"score": s, "n_pieces": len(ids), "ids_crc32": zlib.crc32(np.asarray(ids, "<u4"))} for s, ids in found]
                counts.append(listed[0]["n_pieces"])
                sums.append(listed[0]["ids_crc32"])
                same.append(vocabulary.decode(found[0][1]) == text.replace(MARK, " "))
                lists.append(listed)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_()), pa.array(lists, pa.list_(row))],
                names=["id", "n_pieces", "ids_crc32", "round_trip", "nbest"],
            )

    return documents.select("id", "text").mapInArrow(
        scan, f"id {kind}, n_pieces long, ids_crc32 long, round_trip boolean, nbest array<struct<score:double,n_pieces:bigint,ids_crc32:bigint>>"
    )


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return encode(documents).withColumnRenamed("id", "doc_id")
